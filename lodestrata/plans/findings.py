"""Findings (``p, label, fields array<string>, severity``) as facts, SARIF, JSON and markdown, and ranking of candidates.

A program's findings are listed by label, then fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities of the two levels that aren't ``warning``, and the SARIF schema.
LEVELS = {"error": ("error", "high", "critical"), "note": ("note", "info", "informational")}
SCHEMA, VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
WEIGHTS = (0.5, 0.3, 0.2)


def level(severity="severity") -> Column:
    low = F.lower(severity)
    return F.when(low.isin(*LEVELS["error"]), "error").when(low.isin(*LEVELS["note"]), "note").otherwise("warning")


def _listed() -> Window:
    return Window.partitionBy("p").orderBy("label", "fields")


def finding_facts(found: DataFrame, relation: str = "finding") -> DataFrame:
    """(p, nth, line): numbered facts of a program's findings; numbers in a column ``nth`` are taken as they are."""
    quoted = F.transform("fields", lambda x: F.concat(F.lit(', "'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    nth = F.col("nth") if "nth" in found.columns else F.row_number().over(_listed()) - 1
    return found.select("p", nth.cast("long").alias("nth"), "label", quoted.alias("quoted")).select("p", "nth", F.concat(F.lit(f'{relation}("f'), F.col("nth").cast("string"), F.lit('", "'), "label", F.lit('"'), F.array_join("quoted", ""), F.lit(").")).alias("line"))


def first_per_label(found: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("p", "label").orderBy("fields"))
    return found.withColumn("nth", nth).where("nth = 1").drop("nth")


def sarif_rules(found: DataFrame) -> DataFrame:
    """(p, label, level, n_results): a rule per label."""
    return found.groupBy("p", "label").agg(F.min(level()).alias("level"), F.count("*").alias("n_results"))


def sarif(found: DataFrame, tool: str) -> DataFrame:
    """(p, sarif): a SARIF document per program with findings; its location is the program."""
    uri = F.struct(F.struct(F.struct(F.col("p").cast("string").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    message = F.when(F.size("fields") > 0, F.array_join("fields", ", ")).otherwise(F.col("label"))
    result = F.struct("label", "fields", F.struct(F.col("label").alias("ruleId"), level().alias("level"), F.struct(message.alias("text")).alias("message"), F.array(uri).alias("locations")).alias("made"))
    ordered = found.groupBy("p").agg(F.array_sort(F.collect_list(result)).alias("all"), F.array_sort(F.collect_set(F.struct("label", level().alias("level")))).alias("rules"))
    rules = F.transform("rules", lambda r: F.struct(r["label"].alias("id"), r["label"].alias("name"), F.struct(r["label"].alias("text")).alias("shortDescription"), F.struct(r["level"].alias("level")).alias("defaultConfiguration")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.transform("all", lambda x: x["made"]).alias("results"))
    return ordered.select("p", F.to_json(F.struct(F.lit(SCHEMA).alias("$schema"), F.lit(VERSION).alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def markdown(found: DataFrame, programs: DataFrame) -> DataFrame:
    """(p, report): status, number and list of findings of each program."""
    line = F.concat(F.lit("- **"), "label", F.lit("** ("), "severity", F.lit("): "), F.array_join("fields", ", "))
    listed = found.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("label", "fields", line.alias("line")))).alias("all"))
    lines = F.coalesce(F.transform("all", lambda x: x["line"]), F.array().cast("array<string>"))
    status = F.when(F.size(lines) == 0, "no findings").otherwise("findings")
    head = F.concat(F.lit("# Report of "), F.col("p").cast("string"), F.lit("\n\nStatus: "), status, F.lit("\nFindings: "), F.size(lines).cast("string"), F.lit("\n\n"))
    return programs.select("p").distinct().join(listed, "p", "left").select("p", F.concat(head, F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


def quotes(facts: DataFrame) -> DataFrame:
    """(p, atom, quotes): evidence texts by a fact's first argument, in order, each once."""
    text = facts.where((F.col("class") == "text") & (F.size("args") > 1)).select("p", F.col("args")[0].alias("atom"), F.col("args")[F.size("args") - 1].alias("quote"), "seq")
    first = text.groupBy("p", "atom", "quote").agg(F.min("seq").alias("seq"))
    return first.groupBy("p", "atom").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "quote"))), lambda x: x["quote"]).alias("quotes"))


def neighbourhood(facts: DataFrame, atoms: DataFrame) -> DataFrame:
    """Facts that hold any of the atoms (p, atom) among their arguments, each once, sorted."""
    held = facts.where("class = 'core'").select("p", "relation", "args", F.explode(F.array_distinct("args")).alias("atom"))
    return held.join(atoms.select("p", "atom").distinct(), ["p", "atom"], "left_semi").select("p", "relation", "args").distinct().orderBy("p", "relation", "args")


def composite(match="match_rate", support="support", reference="reference", weights=WEIGHTS) -> Column:
    return F.col(match) * weights[0] + F.col(support) * weights[1] + F.col(reference) * weights[2]


def accepted(candidates: DataFrame) -> DataFrame:
    """Of ``p, nth, score``: adds best (so far, itself included) and accepted (as good as all before it; ties replace)."""
    before = Window.partitionBy("p").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max("score").over(before)
    return candidates.withColumn("best", F.greatest(F.col("score"), F.coalesce(earlier, F.col("score")))).withColumn("accepted", F.coalesce(F.col("score") >= earlier, F.lit(True)))


def latest_rounds(records: DataFrame) -> DataFrame:
    """The last record (by seq) of each (p, iteration, attempts, parent)."""
    w = Window.partitionBy("p", "iteration", "attempts", "parent").orderBy(F.desc("seq"))
    return records.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def patched(lines: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies ``patch(p, kind, target, line)`` - replace, remove, add - to ``lines(p, seq, line)``; targets are compared
    without outer blanks, an added line goes to the end unless it stands already. Returns lines and unmatched targets.
    Of several patches to one target the smallest (kind, line) holds."""
    bare = F.trim("line")
    edits = patch.where("kind <> 'add'").groupBy("p", F.trim("target").alias("t")).agg(F.min(F.struct("kind", F.col("line").alias("new"))).alias("e")).select("p", "t", "e.*")
    merged = lines.withColumn("t", bare).join(edits, ["p", "t"], "left")
    kept = merged.where("kind is null or kind <> 'remove'").select("p", "seq", F.when(F.col("kind") == "replace", F.col("new")).otherwise(F.col("line")).alias("line"))
    added = patch.where("kind = 'add'").select("p", F.trim("line").alias("line")).distinct().join(kept.select("p", bare.alias("line")), ["p", "line"], "left_anti")
    top = kept.groupBy("p").agg(F.max("seq").alias("top"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy("line"))
    added = added.join(top, "p", "left").select("p", (F.coalesce("top", F.lit(-1)) + nth).cast(lines.schema["seq"].dataType).alias("seq"), "line")
    return kept.unionByName(added), edits.select("p", F.col("t").alias("target")).join(lines.select("p", bare.alias("target")), ["p", "target"], "left_anti")
