"""Facts as text, one ``relation(args).`` a line, of many programs.

Arguments are quoted or bare; in quotes a backslash keeps the next character as it is and is dropped.
``//`` outside quotes starts a comment. Quotes can stand anywhere in an argument; blanks around an
argument go, quoted or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The core relations and their columns.
CORE = {
    "skill": "s", "skill_doc_claim": "s claim", "action": "a s", "action_trigger": "a kind", "action_gate": "a kind", "action_param": "a name v",
    "call": "c a", "call_effect": "c kind", "call_code": "c kind", "call_action": "c a", "call_action_arg": "c v1 v2",
    "call_unconditional": "c1 c2", "call_conditional": "c1 c2 v", "call_region": "c v", "call_input": "c v", "call_output": "c v",
    "call_region_untrusted": "c", "call_region_sensitive": "c", "call_region_secret": "c",
    "value": "v a kind", "value_sensitive_allowed_action": "v a", "value_secret_allowed_action": "v a",
}
UNITS = {"evidence_unit": 2, "evidence_unit_type": 2, "evidence_unit_location": 4}
#: Leading columns that name a fact in evidence of it, where that isn't all of them.
KEYS = {"skill": 1, "action": 1, "call": 1, "value": 2}
MECHANICAL = ("call_unconditional", "call_conditional", "value")
ARITY = {r: len(c.split()) for r, c in CORE.items()}
KNOWN = ARITY | UNITS | {f"{r}_evidence{end}": KEYS.get(r, n) + 1 for r, n in ARITY.items() for end in ("", "_text")}
#: Classes in the order in which a program lists its facts.
CLASSES = ("core", "text", "evidence", "unit", "unknown")
PARSE_ERROR = "__parse_error__"
COLUMNS = "p long, seq int, line int, class string, relation string, args array<string>, raw string"

_QUOTED = r'"(?:\\.|[^"\\])*"'
_BEFORE_COMMENT = re.compile(rf'(?:{_QUOTED}|"(?:\\.|[^"\\])*\\?\Z|/(?!/)|[^"/])*', re.S)
_PIECE = re.compile(rf'{_QUOTED}|,|[^",]+', re.S)


class FactError(ValueError):
    """A line that is no fact."""


def parse_fact(text: str) -> tuple[str, list[str]]:
    """Relation and arguments of one line without comment; ``relation()`` has no argument."""
    shape = re.fullmatch(r"([^(]+)\((.*)\)\s*\.", text, re.S)
    if not shape:
        raise FactError("a fact is relation(args).")
    relation, inside = shape[1].strip(), shape[2].strip()
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", relation):
        raise FactError(f"invalid relation name {relation!r}")
    if not inside:
        return relation, []
    args, at = [""], 0
    while at < len(inside):
        piece = _PIECE.match(inside, at)
        if not piece:
            raise FactError("unterminated quoted string")
        found, at = piece[0], piece.end()
        if found == ",":
            args.append("")
        else:
            args[-1] += re.sub(r"\\(.)", r"\1", found[1:-1], flags=re.S) if found[0] == '"' else found
    return relation, [a.strip() for a in args]


def kind_of(relation: str) -> str:
    if relation in CORE:
        return "core"
    if relation in UNITS:
        return "unit"
    if relation in KNOWN:
        return "text" if relation.endswith("_text") else "evidence"
    return "unknown"


def parse_program(text: str, strict: bool = False) -> Iterator[tuple]:
    """(line, class, relation, args, raw) of each line that holds something. Lines that are no facts are of class
    ``unknown`` and relation ``__parse_error__``, or raise if ``strict``; ``#`` lines are ``include`` or ``directive``."""
    for number, line in enumerate(text.splitlines(), 1):
        body = _BEFORE_COMMENT.match(line)[0].strip()
        if not body:
            continue
        if body.startswith("#"):
            yield number, "include" if body.startswith("#include") else "directive", "", [body], line
            continue
        try:
            relation, args = parse_fact(body)
        except FactError as problem:
            if strict:
                raise
            yield number, "unknown", PARSE_ERROR, [str(problem)], line
            continue
        yield number, kind_of(relation), relation, args, body


def scan(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Facts of ``texts(p, text)``, a program per row; ``seq`` counts a program's lines from 0. Null text: no rows."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for frame in frames:
            for p, text in zip(frame["p"], frame["text"]):
                rows = [(p, i, *row) for i, row in enumerate(parse_program(text, strict))] if isinstance(text, str) else []
                if rows:
                    yield pd.DataFrame({c: pd.Series(v, dtype="int64" if c in ("p", "seq", "line") else object) for c, v in zip(names, zip(*rows))})

    return texts.select(F.col("p").cast("long").alias("p"), "text").mapInPandas(read, COLUMNS)


def relation_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The core relations of ``p, relation, args``; rows of other arity are left out."""
    return {r: facts.where((F.col("relation") == r) & (F.size("args") == ARITY[r])).select("p", *(F.col("args")[i].alias(c) for i, c in enumerate(columns.split()))).distinct() for r, columns in CORE.items()}


def rendered(relation="relation", args="args"):
    """A fact as text, every argument quoted."""
    quoted = F.transform(args, lambda a: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(a, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    return F.concat(F.col(relation), F.lit("("), F.array_join(quoted, ", "), F.lit(")."))
