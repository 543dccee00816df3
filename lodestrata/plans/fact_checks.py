"""Checks and metrics of scanned facts (``fact_text.scan``): shape, include, duplicates, typed evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.sources.fact_text import CLASSES, CORE, KEYS, KNOWN, MECHANICAL, PARSE_ERROR, rendered

ISSUE = ("p", "code", "message", "line", "severity")


def _issues(df: DataFrame, code: str, message: Column, severity: str = "error", line: str | None = "line") -> DataFrame:
    return df.select("p", F.lit(code).alias("code"), message.alias("message"), (F.col(line) if line else F.lit(0)).alias("line"), F.lit(severity).alias("severity"))


def _is_fact() -> Column:
    return F.col("class").isin(*CLASSES)


def support_key() -> Column:
    """What evidence names a fact by: its relation and arguments, of entities the leading ones only."""
    size, relation = F.size("args"), F.col("relation")
    kept = size
    for r, n in KEYS.items():
        kept = F.when((relation == r) & (size >= n), n).otherwise(kept)
    core = F.struct(relation.alias("of"), F.slice("args", 1, kept).alias("key"))
    cut = F.greatest(size - 1, F.lit(0))
    return F.when(F.col("class") == "core", core).otherwise(F.struct(F.regexp_replace(relation, "_evidence(_text)?$", "").alias("of"), F.slice("args", 1, cut).alias("key")))


def shape_issues(facts: DataFrame) -> DataFrame:
    """SDL001 lines that are no facts, SDL002 unknown relations, SDL003 wrong numbers of arguments."""
    relation = F.col("relation")
    arity = F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv))[relation]
    unknown = facts.where(F.col("class") == "unknown")
    return (
        _issues(unknown.where(relation == PARSE_ERROR), "SDL001", F.col("args")[0])
        .unionByName(_issues(unknown.where(relation != PARSE_ERROR), "SDL002", F.concat(F.lit("unknown relation "), relation)))
        .unionByName(_issues(facts.where(_is_fact() & (relation != PARSE_ERROR) & (F.size("args") != arity)), "SDL003", F.format_string("%s expects %d args, got %d", relation, arity, F.size("args"))))
    )


def include_issues(facts: DataFrame, programs: DataFrame, library: str) -> DataFrame:
    """SDL004: programs (column p) without an include that names the rule library."""
    having = facts.where((F.col("class") == "include") & F.contains(F.col("args")[0], F.lit(library))).select("p")
    return _issues(programs.select("p").distinct().join(having, "p", "left_anti"), "SDL004", F.lit(f"missing #include for {library}"), line=None)


def single_issues(facts: DataFrame, programs: DataFrame) -> DataFrame:
    """SDL005: programs without exactly one skill fact; repeated ones count."""
    counted = facts.where(F.col("relation") == "skill").groupBy("p").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _issues(programs.select("p").distinct().join(counted, "p", "left").where(n != 1), "SDL005", F.format_string("expected exactly one skill fact, found %d", n), line=None)


def duplicate_issues(facts: DataFrame) -> DataFrame:
    """SDL030: a fact's second and later occurrences, in the order of classes, then of lines."""
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    w = Window.partitionBy("p", "relation", "args").orderBy(rank, "seq")
    again = facts.where(_is_fact() & (F.col("relation") != PARSE_ERROR)).withColumn("nth", F.row_number().over(w)).where("nth > 1")
    return _issues(again, "SDL030", F.concat(F.lit("duplicate fact "), rendered()))


def evidence_issues(facts: DataFrame, required: bool = True) -> DataFrame:
    """Warnings: EVD010 handles of no unit (only in programs with units), EVD011 evidence of no core fact, EVD012 core
    facts without evidence (mechanical ones need none)."""
    keyed = facts.withColumn("k", support_key())
    core, of_core = keyed.where(F.col("class") == "core"), keyed.where(F.col("class").isin("text", "evidence"))
    units = facts.where((F.col("relation") == "evidence_unit") & (F.size("args") > 0)).select("p", F.col("args")[0].alias("handle")).distinct()
    handle = F.try_element_at("args", F.lit(-1))
    handled = facts.where((F.col("class") == "evidence") & F.startswith(handle, F.lit("su_"))).withColumn("handle", handle)
    lost = handled.join(units.select("p").distinct(), "p", "left_semi").join(units, ["p", "handle"], "left_anti")
    out = _issues(lost, "EVD010", F.concat("relation", F.lit(" references unknown evidence handle "), "handle"), "warning")
    out = out.unionByName(_issues(of_core.join(core.select("p", "k"), ["p", "k"], "left_anti"), "EVD011", F.concat("relation", F.lit(" does not target an existing core fact")), "warning"))
    if required:
        bare = core.where(~F.col("relation").isin(*MECHANICAL)).join(of_core.select("p", "k"), ["p", "k"], "left_anti")
        out = out.unionByName(_issues(bare, "EVD012", F.concat(F.lit("core fact lacks typed evidence: "), rendered()), "warning"))
    return out


def support_coverage(facts: DataFrame, programs: DataFrame) -> DataFrame:
    """(p, coverage): share of core facts, mechanical ones aside, that some evidence names; 1 where there are none."""
    keyed = facts.withColumn("k", support_key())
    named = keyed.where(F.col("class").isin("text", "evidence")).select("p", "k").distinct().withColumn("hit", F.lit(1))
    core = keyed.where((F.col("class") == "core") & ~F.col("relation").isin(*MECHANICAL)).join(named, ["p", "k"], "left")
    share = core.groupBy("p").agg((F.count("hit") / F.count("*")).alias("coverage"))
    return programs.select("p").distinct().join(share, "p", "left").select("p", F.round(F.coalesce("coverage", F.lit(1.0)), 6).alias("coverage"))


def text_issues(facts: DataFrame, programs: DataFrame, library: str | None = None, evidence: bool = False) -> DataFrame:
    """All issues of this module; the include is asked for where ``library`` is given."""
    out = shape_issues(facts).unionByName(single_issues(facts, programs)).unionByName(duplicate_issues(facts))
    if library is not None:
        out = out.unionByName(include_issues(facts, programs, library))
    return out.unionByName(evidence_issues(facts, required=evidence)).select(*ISSUE)


def validity(issues: DataFrame, programs: DataFrame) -> DataFrame:
    """(p, valid): no issue of severity error."""
    broken = issues.where("severity = 'error'").select("p").distinct().withColumn("bad", F.lit(True))
    return programs.select("p").distinct().join(broken, "p", "left").select("p", F.col("bad").isNull().alias("valid"))


__all__ = ["CORE", "duplicate_issues", "evidence_issues", "include_issues", "shape_issues", "single_issues", "support_coverage", "text_issues", "validity"]
