"""Findings of whole programs: all rules of ``plans.relations`` over the facts of one program at a time.

A program's facts, or the orders that they are made of, come as one row, and its values and calls are bits of integers, so what a value reaches and which
calls it gets to is never a table. Rows are made from codes of the program's sorted strings; they leave sorted by label and fields.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.table_facts import order_facts

#: Facts up to which a program is judged in memory, and rows that a batch of findings holds.
MAX_FACTS, BATCH_FINDINGS = 4_000, 50_000
#: Programs whose facts are Python objects at once.
STEP_PROGRAMS = 50
#: What is read: the columns of each relation, at most three.
READ = {
    "skill_doc_claim": "s claim", "action": "a s", "action_trigger": "a kind", "action_gate": "a kind", "action_param": "a v name", "call": "c a",
    "call_effect": "c kind", "call_code": "c kind", "call_unconditional": "c1 c2", "call_conditional": "c1 c2 v", "call_region": "c v",
    "call_region_untrusted": "c", "call_region_sensitive": "c", "call_region_secret": "c", "call_input": "c v", "call_output": "c v", "value": "v kind",
    "call_action": "c a", "call_action_arg": "v1 v2", "value_sensitive_allowed_action": "v a", "value_secret_allowed_action": "v a",
}
NUMBER = {relation: k for k, relation in enumerate(READ)}
#: The last of these columns can be null.
LOOSE = {"action_param", "call_conditional", "value"}
OVERREACH = "sensitive_local_resource_overreach"
_MADE = ("secret", "sensitive_local", "remote_killswitch", "dead_obfuscated", "dead_encoded_binary")
_HIDDEN = ("obfuscated", "encoded_binary")


def rows_of(tables: dict[str, DataFrame]) -> Iterator[DataFrame]:
    """(p, k, x, y, z) for each relation of ``READ``: its number and columns."""
    for k, (relation, columns) in enumerate(READ.items()):
        names = columns.split()
        needed = ["p", *names[: -1 if relation in LOOSE else None]]
        sides = [F.col(c) for c in names] + [F.lit(None).cast("string")] * (3 - len(names))
        df = tables[relation].where(" and ".join(f"{c} is not null" for c in needed))
        yield df.select("p", F.lit(k).alias("k"), *(x.alias(n) for x, n in zip(sides, "xyz")))


def packed(facts: DataFrame) -> DataFrame:
    """(p, facts) or (p, orders): a program a row; facts and orders that are dealt by p stay where they are."""
    name = "facts" if "k" in facts.columns else "orders"
    return facts.groupBy("p").agg(F.collect_list(F.struct(*(c for c in facts.columns if c != "p"))).alias(name))


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _matrix(masks: list[int], n: int) -> np.ndarray:
    width = (n + 7) // 8
    rows = np.frombuffer(b"".join(m.to_bytes(width, "little") for m in masks), np.uint8).reshape(len(masks), width)
    return np.unpackbits(rows, axis=1, bitorder="little")[:, :n].astype(np.float32)


class Program:
    """Facts of one program as codes, and what the rules have in common."""

    def __init__(self, facts: list[tuple], secret_names: list[str], blocks: dict[str, str]):
        self.names = sorted({s for f in facts for s in f[1:] if s is not None} | set(_MADE))
        self.code = code = {s: i for i, s in enumerate(self.names)}
        code[None] = -1
        self.blocks = blocks
        of = self.of = {r: set() for r in READ}
        kinds = [(of[r], len(columns.split())) for r, columns in READ.items()]
        for k, *args in facts:
            found, width = kinds[k]
            found.add(tuple([code[x] for x in args[:width]]))
        group = lambda r, a=0, b=1: self._grouped(((f[a], f[b]) for f in of[r]))
        self.effects, self.codes, self.region = group("call_effect"), group("call_code"), group("call_region")
        skills = group("action")
        self.acall = sorted({(s, a, c) for c, a in of["call"] for s in skills.get(a, ())})
        self.gated = {a for a, _ in of["action_gate"]}
        strong = code.get("human_approval", -2)
        self.strong = {a for a, kind in of["action_gate"] if kind == strong}
        self.marked = {k: {c for c, in of[f"call_region_{k}"]} for k in ("untrusted", "sensitive", "secret")}
        self.edges = {f[:2] for r in ("call_unconditional", "call_conditional") for f in of[r]}
        self._values(secret_names, skills)
        flowing = self.mark_of_values("untrusted")
        self.tainted = lambda c: c in self.marked["untrusted"] or bool(self.inputs.get(c, 0) & flowing)
        self.flowing = flowing
        net, agent = self.any_of("net_write"), self.any_of("net_write", "agent_call")
        strong_effects = self.any_of("proc_exec", "code_eval", "chain_write", "crypto_sign")
        self.high = {c for c, e in self.effects.items() if e & strong_effects or (e & net and self.tainted(c))}
        self.egress = {c for c, e in self.effects.items() if e & agent and self.tainted(c)}

    @staticmethod
    def _grouped(pairs) -> dict[int, set]:
        out: dict[int, set] = defaultdict(set)
        for a, b in pairs:
            out[a].add(b)
        return out

    def any_of(self, *names: str) -> set[int]:
        return {self.code[n] for n in names if n in self.code}

    def _values(self, secret_names: list[str], skills: dict[int, set]) -> None:
        """Bits of values, what each reaches, and the sources."""
        of, place = self.of, {}
        bit = lambda v: 1 << place.setdefault(v, len(place))
        masks = lambda pairs: self._masks(pairs, bit)
        self.inputs, self.outputs = masks(of["call_input"]), masks(of["call_output"])
        params = masks((a, v) for a, v, _ in of["action_param"])
        declared = [v for v, _ in of["value"]] + [v for _, v, _ in of["action_param"]]
        before, after = {y for _, y in self.edges}, {x for x, _ in self.edges}
        leaf_output: dict[int, int] = defaultdict(int)
        reach: dict[int, int] = defaultdict(int)

        def flow(sources: int, targets: int) -> None:
            if targets:
                for v in _bits(sources):
                    reach[v] |= targets

        for c, a in of["call"]:
            if c not in after:
                leaf_output[a] |= self.outputs.get(c, 0)
            if c not in before and a in params:
                flow(params[a], self.inputs.get(c, 0))
        for c, mask in self.inputs.items():
            flow(mask, self.outputs.get(c, 0))
        for x, y in self.edges:
            flow(self.outputs.get(x, 0), self.inputs.get(y, 0))
        for v, w in of["call_action_arg"]:
            source = bit(v).bit_length() - 1
            reach[source] |= bit(w)
        for c, a in of["call_action"]:
            flow(leaf_output.get(a, 0), self.outputs.get(c, 0))
        for a, mask in list(leaf_output.items()):
            for b, targets in params.items():
                if a != b and skills.get(a, set()) & skills.get(b, set()):
                    flow(mask, targets)
        for k in range(len(place)):
            if (step := reach.get(k, 0)) and (own := 1 << k):
                for i, mask in reach.items():
                    if mask & own:
                        reach[i] = mask | step
        for v in declared:
            reach[bit(v).bit_length() - 1] |= bit(v)
        trusted_kinds = self.any_of("param", "untrusted")
        outside = {a for a, kind in of["action_trigger"] if kind in self.any_of("external", "on_import", "on_install")}
        reading = self.any_of("net_read", "agent_call", "fs_read", "db_read", "env_read")
        union = lambda found: reduce(int.__or__, found, 0)
        kind = lambda *names: union(bit(v) for v, k in of["value"] if k in self.any_of(*names))
        put_out = lambda k: union(self.outputs.get(c, 0) for c in self.marked[k])
        untrusted = union(bit(v) for v, k in of["value"] if k in trusted_kinds) | union(params.get(a, 0) for a in outside)
        untrusted |= union(self.outputs.get(c, 0) for c in self.marked["untrusted"] if self.effects.get(c, set()) & reading)
        named = union(bit(v) for _, v, n in of["action_param"] if n >= 0 and any(x in self.names[n] for x in secret_names))
        self.sources = {"untrusted": untrusted, "sensitive_local": kind("sensitive_local") | put_out("sensitive"), "secret": kind("secret") | put_out("secret") | named}
        self.literal = kind("literal")
        self.allowed = {k: of[r] for k, r in (("secret", "value_secret_allowed_action"), ("sensitive_local", "value_sensitive_allowed_action"))}
        self.value_at = list(place)
        self.place, self.reach = place, reach

    @staticmethod
    def _masks(pairs, bit) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for x, v in pairs:
            out[x] |= bit(v)
        return out

    def mark_of_values(self, kind: str) -> int:
        return reduce(int.__or__, (self.reach.get(v, 0) for v in _bits(self.sources[kind])), 0)

    def reached(self, kinds: tuple[str, ...]) -> tuple[list[int], np.ndarray]:
        """Sources of the kinds, and for each (row) the values that it reaches."""
        mask = reduce(int.__or__, (self.sources[k] for k in kinds), 0)
        at = list(_bits(mask))
        return at, _matrix([self.reach.get(v, 0) for v in at], len(self.value_at))

    def by_call(self, masks: list[int], rows: np.ndarray) -> np.ndarray:
        """Number of the values of each mask (of a call) that each row holds."""
        return _matrix(masks, len(self.value_at)) @ rows.T

    def _rows_of(self, picks: list[tuple[int, np.ndarray, int | None]], at: list[int]) -> np.ndarray:
        """Codes s, a, c, (kind,) src of the sources picked for calls of ``acall``."""
        out, values = [], np.array([self.value_at[v] for v in at], dtype=np.int64)
        for i, picked, kind in picks:
            src = values[picked]
            row = np.empty((len(src), 4 if kind is None else 5), dtype=np.int64)
            row[:, :3], row[:, -1] = self.acall[i], src
            if kind is not None:
                row[:, 3] = kind
            out.append(row)
        return np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)

    def sensitive_local_resource_overreach(self) -> np.ndarray:
        kinds = ("secret", "sensitive_local")
        at, rows = self.reached(kinds)
        calls = [i for i, (_, _, c) in enumerate(self.acall) if self.inputs.get(c, 0)]
        if not at or not calls:
            return np.zeros((0, 5), dtype=np.int64)
        masks = [self.inputs[self.acall[i][2]] for i in calls]
        held = _matrix(masks, len(self.value_at))
        got = held @ rows.T
        # (sink, src) pairs that differ from an untrusted one of the call in both
        bad_at, bad = self.reached(("untrusted",))
        number = {v: j for j, v in enumerate(bad_at)}
        others = np.tile(bad.sum(axis=0), (len(at), 1))
        for j, v in enumerate(at):
            if v in number:
                others[j] -= bad[number[v]]
        other = (others > 0).astype(np.float32)
        beside = got * (held @ other.T) - held @ (rows * other).T > 0
        own = {k: np.array([bool(self.sources[k] >> v & 1) for v in at]) for k in kinds}
        may: dict[tuple[str, int], np.ndarray] = {}
        picks = []
        for row, i in enumerate(calls):
            _, a, c = self.acall[i]
            for k in kinds:
                if (k, a) not in may:
                    may[k, a] = np.array([(self.value_at[v], a) in self.allowed[k] for v in at])
                picked = (got[row] > 0) & own[k]
                if c not in self.egress:
                    picked &= ~may[k, a] | (beside[row] if a not in self.strong else False)
                if picked.any():
                    picks.append((i, picked, self.code[k]))
        return self._rows_of(picks, at)

    def implicit_egress_channels(self) -> np.ndarray:
        kinds = ("secret", "sensitive_local")
        at, rows = self.reached(kinds)
        calls = [i for i, (_, a, c) in enumerate(self.acall) if c in self.egress and a not in self.strong and self.inputs.get(c, 0)]
        if not at or not calls:
            return np.zeros((0, 5), dtype=np.int64)
        got = self.by_call([self.inputs[self.acall[i][2]] for i in calls], rows) > 0
        own = {k: np.array([bool(self.sources[k] >> v & 1) for v in at]) for k in kinds}
        return self._rows_of([(i, got[row] & own[k], self.code[k]) for row, i in enumerate(calls) for k in kinds], at)

    def unsanitized_context_ingestion(self) -> np.ndarray:
        at, rows = self.reached(("untrusted",))
        calls = [i for i, (_, a, c) in enumerate(self.acall) if c in self.high and a not in self.strong and self.inputs.get(c, 0) & ~self.literal]
        if not at or not calls:
            return np.zeros((0, 4), dtype=np.int64)
        got = self.by_call([self.inputs[self.acall[i][2]] & ~self.literal for i in calls], rows) > 0
        return self._rows_of([(i, got[row], None) for row, i in enumerate(calls)], at)

    def unverifiable_dependency_source(self) -> set[tuple]:
        fetch, run, now = self.any_of("net_read", "agent_call"), self.any_of("proc_exec", "code_eval"), self.any_of("proc_exec", "code_eval", "net_read")
        unresolved = self.code.get("unresolved_target", -2)
        runs = self._grouped(((s, a), c) for s, a, c in self.acall if self.effects.get(c, set()) & run)
        out = set()
        for s, a, c in self.acall:
            if c not in self.marked["untrusted"]:
                continue
            effects = self.effects.get(c, set())
            if effects & fetch and (s, a) in runs:
                mask = reduce(int.__or__, (self.reach.get(v, 0) for v in _bits(self.outputs.get(c, 0))), 0)
                out |= {(s, a, y, c) for y in runs[s, a] if y != c and self.inputs.get(y, 0) & mask}
            if effects & now and unresolved in self.codes.get(c, set()):
                out.add((s, a, c, c))
        return out

    def dangerous_execution_primitives(self) -> set[tuple]:
        run, hidden, read, start = self.any_of("proc_exec", "code_eval"), self.any_of(*_HIDDEN), self.any_of("net_read"), self.any_of("proc_exec")
        out = {k for k in self.acall if self.effects.get(k[2], set()) & run and (self.tainted(k[2]) or self.codes.get(k[2], set()) & hidden)}
        homes = self._grouped((c, (s, a)) for s, a, c in self.acall)
        for x, y in self.edges:
            if self.effects.get(x, set()) & read and self.effects.get(y, set()) & start:
                out |= {(s, a, y) for s, a in homes.get(x, set()) & homes.get(y, set())}
        return out

    def behavior_claim_contradiction(self) -> set[tuple]:
        claims = self._grouped(self.of["skill_doc_claim"])
        ruled = {claim: self.any_of(*self.blocks.get(self.names[claim], "").split()) for found in claims.values() for claim in found}
        return {(s, a, c, claim, kind) for s, a, c in self.acall for claim in claims.get(s, ()) for kind in self.effects.get(c, set()) & ruled[claim]}

    def ungated_irreversible_operation(self) -> set[tuple]:
        return {k for k in self.acall if k[2] in self.high and k[1] not in self.gated}

    def hardcoded_c2_communication(self) -> set[tuple]:
        net, unresolved = self.any_of("net_read", "net_write"), self.code.get("unresolved_target", -2)
        return {(*k, v) for k in self.acall if k[2] in self.marked["untrusted"] and self.effects.get(k[2], set()) & net and unresolved in self.codes.get(k[2], set()) for v in self.region.get(k[2], ())}

    def shadow_credentials(self) -> set[tuple]:
        reads, out = self.any_of("fs_read", "fs_list", "env_read", "db_read"), {s for s, _, c in self.acall if c in self.egress}
        kinds = [(self.code["secret"], self.marked["secret"]), (self.code["sensitive_local"], self.marked["sensitive"])]
        return {(*k, kind) for k in self.acall if k[0] in out and self.effects.get(k[2], set()) & reads for kind, calls in kinds if k[2] in calls}

    def obfuscation(self) -> set[tuple]:
        hidden = self.any_of(*_HIDDEN)
        return {(*k, kind) for k in self.acall for kind in self.codes.get(k[2], set()) & hidden}

    def dormant_malicious_payload(self) -> set[tuple]:
        switched = {c for _, c, v in self.of["call_conditional"] if v in self.place and self.flowing >> self.place[v] & 1}
        out = {(*k, self.code["remote_killswitch"]) for k in self.acall if k[2] in self.high and k[2] in switched}
        after, targets = self._grouped(self.edges), {y for _, y in self.edges}
        seen, stack = set(), [c for c, _ in self.of["call"] if c not in targets]
        while stack:
            if (c := stack.pop()) not in seen:
                seen.add(c)
                stack += after.get(c, ())
        for k in self.obfuscation():
            out.add(k)
            if k[2] not in seen:
                out.add((*k[:3], self.code["dead_" + self.names[k[3]]]))
        return out


def _sorted(rows: np.ndarray | set[tuple]) -> np.ndarray:
    """Rows in order, each once."""
    if isinstance(rows, set):
        return np.array(sorted(rows), dtype=np.int64) if rows else np.zeros((0, 1), dtype=np.int64)
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]


def _programs(batches: Iterator[pa.RecordBatch], labels: list[str], secret_names: list[str], blocks: dict[str, str]) -> Iterator[tuple]:
    """(p, names, label, rows) for each program and label with findings, by label."""
    for batch in (b.slice(i, STEP_PROGRAMS) for b in batches for i in range(0, b.num_rows, STEP_PROGRAMS)):
        orders, lists = batch.schema.names[1] == "orders", batch.column(1)
        facts = list(zip(*(x.to_pylist() for x in lists.flatten().flatten())))
        edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).tolist()
        for p, a, b in zip(batch.column("p").to_pylist(), edges, edges[1:]):
            program = Program(order_facts(p, facts[a:b], NUMBER) if orders else facts[a:b], secret_names, blocks)
            for label in labels:
                rows = _sorted(getattr(program, label)())
                if len(rows):
                    yield p, program.names, label, rows


def _gathered(found: Iterator[tuple], first_only: bool) -> Iterator[tuple]:
    """Columns p, label, n, nth, all strings, codes (flat) and width of each row, of a bounded number of rows."""
    held, size, names, base, top, now, nth = [], 0, [], 0, 0, None, 0
    for p, own, label, rows in found:
        if p != now:
            now, nth = p, 0
        total = len(rows)
        for i in range(0, 1 if first_only else total, BATCH_FINDINGS):
            part = rows[i : i + (1 if first_only else BATCH_FINDINGS)]
            if not names or names[-1] is not own:
                base, top = top, top + len(own)
                names.append(own)
            held.append((p, label, total, nth + i, part + base))
            size += len(part)
            if size >= BATCH_FINDINGS:
                yield held, names
                held, size, names, top = [], 0, [], 0
        nth += total
    if held:
        yield held, names


def _columns(held: list[tuple], names: list[list[str]]) -> tuple:
    sizes = np.array([len(x[4]) for x in held])
    repeat = lambda i: np.repeat([x[i] for x in held], sizes)
    nth = repeat(3) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    label = pa.array([x[1] for x in held]).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
    strings = pa.array([s for own in names for s in own], pa.string())
    return repeat(0), label, repeat(2), nth, strings, sizes


def findings(programs: DataFrame, labels: list[str], secret_names: list[str], blocks: dict[str, str], first_only: bool = False) -> DataFrame:
    """(p, label, n, nth, fields) of ``packed`` programs: a finding a row, its place among its program's, and the number of
    those of its label. With ``first_only`` the first of each label."""
    labels = sorted(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, names in _gathered(_programs(batches, labels, secret_names, blocks), first_only):
            p, label, n, nth, strings, sizes = _columns(held, names)
            widths = np.repeat([x[4].shape[1] for x in held], sizes)
            values = strings.take(pa.array(np.concatenate([x[4].ravel() for x in held])))
            fields = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(widths))).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), label, pa.array(n, pa.int64()), pa.array(nth, pa.int64()), fields], names=["p", "label", "n", "nth", "fields"])

    return programs.mapInArrow(run, "p long, label string, n long, nth long, fields array<string>")


def label_rows(programs: DataFrame, label: str, columns: str, secret_names: list[str], blocks: dict[str, str]) -> DataFrame:
    """(p, *columns) of the findings of one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, names in _gathered(_programs(batches, [label], secret_names, blocks), False):
            p, _, _, _, strings, _ = _columns(held, names)
            rows = np.concatenate([x[4] for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), *(strings.take(pa.array(rows[:, i])) for i in range(rows.shape[1]))], names=["p", *columns.split()])

    return programs.mapInArrow(run, "p long, " + ", ".join(f"{c} string" for c in columns.split()))
