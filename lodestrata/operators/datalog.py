"""Evaluates a parsed Datalog program over many independent programs' facts at once.

A relation is a DataFrame ``p, c0, c1, ...`` of strings without repeated rows; rows of other arity
under the same name are a relation of their own, which an atom of this arity doesn't see. ``p`` is in
the keys of every join. Rules become joins, semi joins and anti joins; strongly connected relations
run as a semi-naive loop, all others once.

Literals are taken left to right, as written: a negation sees the variables bound so far, the others
match anything. A variable that a test or a head needs and nothing binds is an error, even where no
row would reach it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.datalog_text import DatalogError, Literal, Program, Rule
from lodestrata.operators.closure import settle

Key = tuple[str, int]
#: Parts of a growing relation that are kept apart before they are written as one.
PARTS = 12


def layers(program: Program) -> list[list[str]]:
    """Groups of relations that depend on each other, each after what it reads; a negation inside one is an error."""
    reads: dict[str, set[str]] = {}
    denied: set[tuple[str, str]] = set()
    for rule in program.rules:
        for literal in rule.body:
            if not literal.is_test:
                reads.setdefault(rule.head.relation, set()).add(literal.relation)
                if literal.negated:
                    denied.add((rule.head.relation, literal.relation))
        reads.setdefault(rule.head.relation, set())
    names = sorted(set(reads) | set().union(*reads.values(), ()))
    after = {n: sorted(reads.get(n, ())) for n in names}
    before: dict[str, list[str]] = {n: [] for n in names}
    for n, found in after.items():
        for m in found:
            before[m].append(n)

    def finished(graph: dict[str, list[str]], starts: list[str], seen: set[str]):
        """Names by the time at which a depth-first walk leaves them, one list for each start."""
        for start in starts:
            if start in seen:
                continue
            seen.add(start)
            left, stack = [], [(start, iter(graph[start]))]
            while stack:
                n, more = stack[-1]
                m = next((x for x in more if x not in seen), None)
                if m is None:
                    left.append(stack.pop()[0])
                else:
                    seen.add(m)
                    stack.append((m, iter(graph[m])))
            yield left

    # two walks: by leaving times over readers, then over what is read
    times = [n for group in finished(before, names, set()) for n in group]
    groups = [sorted(g) for g in finished(after, times[::-1], set())]
    home = {n: i for i, g in enumerate(groups) for n in g}
    for head, literal in sorted(denied):
        if home[head] == home[literal]:
            raise DatalogError(f"{head!r} depends on its own negation through {literal!r}")
    # a component's number may come before that of what it reads: order by the reads between groups
    order: list[int] = []
    needs = {i: {home[m] for n in g for m in after[n]} - {i} for i, g in enumerate(groups)}
    ready = [i for i in sorted(needs) if not needs[i]]
    waits = {i: len(needs[i]) for i in needs}
    readers: dict[int, list[int]] = {i: [] for i in needs}
    for i, found in needs.items():
        for j in found:
            readers[j].append(i)
    while ready:
        i = ready.pop()
        order.append(i)
        for j in readers[i]:
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return [groups[i] for i in order]


def evaluate(spark: SparkSession, program: Program, given: dict[str, DataFrame] | None = None, programs: DataFrame | None = None) -> dict[Key, DataFrame]:
    """All relations by (name, arity). ``given`` holds facts by relation: ``p`` (long) first, then its string columns,
    whatever their names. Facts and rules of ``program`` hold for every p of ``programs`` (column p); without that, for
    those of ``given``, and for the single p = 0 where there is none either."""
    known: dict[Key, DataFrame] = {}
    for name, df in (given or {}).items():
        arity = len(df.columns) - 1
        known[name, arity] = df.toDF("p", *(f"c{i}" for i in range(arity))).distinct()
    if programs is None:
        programs = reduce(DataFrame.unionByName, [df.select("p") for df in known.values()]) if known else spark.createDataFrame([(0,)], "p long")
    programs = programs.select("p").distinct()
    for name, rows in program.facts.items():
        for arity in sorted({len(r) for r in rows}):
            literal = spark.createDataFrame(sorted(r for r in rows if len(r) == arity), ", ".join(f"c{i} string" for i in range(arity)))
            here = programs.join(F.broadcast(literal))  # facts that the text states, for every program
            known[name, arity] = here.unionByName(known[name, arity]).distinct() if (name, arity) in known else here
    for group in layers(program):
        rules = [r for r in program.rules if r.head.relation in group]
        if not rules:
            continue
        if any(x.relation in group for r in rules for x in r.body):
            _fixpoint(rules, set(group), known, programs)
        else:
            for key in {_key(r.head): None for r in rules}:
                made = [_fired(r, known, programs) for r in rules if _key(r.head) == key]
                known[key] = reduce(DataFrame.unionByName, made + ([known[key]] if key in known else [])).distinct()
    return known


def outputs(spark: SparkSession, program: Program, given: dict[str, DataFrame] | None = None, programs: DataFrame | None = None) -> DataFrame:
    """Rows of all ``.output`` relations as ``p, relation, args``."""
    known = evaluate(spark, program, given, programs)
    found = [df.select("p", F.lit(n).alias("relation"), F.array(*(f"c{i}" for i in range(k))).alias("args")) for (n, k), df in known.items() if n in program.outputs]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "p long, relation string, args array<string>")


def write_outputs(found: DataFrame, path: str) -> None:
    """One tab-separated file per relation, sorted by its values, without header."""
    lines = found.select("relation", F.concat_ws("\t", "args").alias("line"), "args").repartition("relation").sortWithinPartitions("relation", "args")
    lines.select("relation", "line").write.mode("overwrite").partitionBy("relation").text(path)


def _key(literal: Literal) -> Key:
    return literal.relation, len(literal.terms)


def _scan(literal: Literal, df: DataFrame, keep: list[str]) -> DataFrame:
    """``p`` and the variables in ``keep``, under their names; constants and repeated variables select."""
    first: dict[str, str] = {}
    for i, t in enumerate(literal.terms):
        if not t.variable:
            df = df.where(F.col(f"c{i}") == F.lit(t.value))
        elif t.value in keep:
            if t.value in first:
                df = df.where(F.col(f"c{i}") == F.col(first[t.value]))
            else:
                first[t.value] = f"c{i}"
    return df.select("p", *(F.col(c).alias(f"v_{v}") for v, c in first.items()))


def _value(term, bound: list[str]):
    if not term.variable:
        return F.lit(term.value)
    if term.value not in bound:
        raise DatalogError(f"variable {term.value!r} isn't bound where it is used")
    return F.col(f"v_{term.value}")


def _fired(rule: Rule, known: dict[Key, DataFrame], programs: DataFrame, replaced: dict[int, DataFrame] | None = None) -> DataFrame:
    """Rows of the rule's head; ``replaced`` gives other rows to the literals at these places."""
    now, bound = programs, []
    untouched = True
    for at, literal in enumerate(rule.body):
        names = list(dict.fromkeys(t.value for t in literal.terms if t.variable))
        if not literal.is_test:
            df = replaced[at] if replaced and at in replaced else known.get(_key(literal))
            if literal.negated:
                shared = [v for v in names if v in bound]
                if df is not None:
                    now = now.join(_scan(literal, df, shared), ["p", *(f"v_{v}" for v in shared)], "left_anti")
            else:
                if df is None:
                    now, df = now.where(F.lit(False)), programs.where(F.lit(False)).select("p", *(F.lit("").alias(f"c{i}") for i in range(len(literal.terms))))
                used = {t.value for x in (*rule.body[:at], *rule.body[at + 1 :], rule.head) for t in x.terms if t.variable}
                names = [v for v in names if v in used or sum(t.value == v for t in literal.terms) > 1]
                scan = _scan(literal, df, names)
                shared = [v for v in names if v in bound]
                if untouched:
                    now = scan
                elif len(shared) == len(names):
                    now = now.join(scan, ["p", *(f"v_{v}" for v in shared)], "left_semi")
                else:
                    now = now.join(scan, ["p", *(f"v_{v}" for v in shared)])
                bound += [v for v in names if v not in bound]
            untouched = False
            continue
        untouched = False
        left, right = literal.terms
        if literal.relation == "=":
            free = [t for t in (left, right) if t.variable and t.value not in bound]
            if len(free) == 1:
                other = right if free[0] is left else left
                now = now.withColumn(f"v_{free[0].value}", _value(other, bound))
                bound.append(free[0].value)
                continue
        a, b = _value(left, bound), _value(right, bound)
        now = now.where({"=": a == b, "!=": a != b, "contains": F.contains(b, a)}[literal.relation])
    return now.select("p", *(_value(t, bound).alias(f"c{i}") for i, t in enumerate(rule.head.terms)))


def _fixpoint(rules: list[Rule], group: set[str], known: dict[Key, DataFrame], programs: DataFrame) -> None:
    keys = list(dict.fromkeys(_key(r.head) for r in rules))
    own = lambda r: [i for i, x in enumerate(r.body) if x.relation in group]
    parts: dict[Key, list[DataFrame]] = {}
    for key in keys:
        made = [_fired(r, known, programs) for r in rules if _key(r.head) == key and not own(r)]
        made += [known[key]] if key in known else []
        parts[key] = [settle(reduce(DataFrame.unionByName, made).distinct())] if made else []
    fresh = {k: v[0] for k, v in parts.items() if v}
    while fresh:
        for key, found in parts.items():
            if found:
                known[key] = reduce(DataFrame.unionByName, found)
        step: dict[Key, list[DataFrame]] = {}
        for rule in rules:
            for at in own(rule):
                if (new := fresh.get(_key(rule.body[at]))) is not None:
                    step.setdefault(_key(rule.head), []).append(_fired(rule, known, programs, {at: new}))
        fresh = {}
        for key, made in step.items():
            new = reduce(DataFrame.unionByName, made).distinct()
            if parts[key]:
                new = new.join(known[key], new.columns, "left_anti")
            new = settle(new)
            if not new.isEmpty():
                fresh[key] = new
                parts[key] = [settle(known[key]), new] if len(parts[key]) >= PARTS else [*parts[key], new]
    for key, found in parts.items():
        if found:
            known[key] = reduce(DataFrame.unionByName, found)
