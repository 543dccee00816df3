"""Queries beside the rule library: programs from Datalog text, scanned facts and their checks, alignment, reports.

``relation`` and ``clause`` are handed in by the catalog: rows of a relation over the driver tables' facts, and the WITH clause of several.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.datalog_text import parse_text
from lodestrata.functions.units import units
from lodestrata.operators import alignment
from lodestrata.operators.closure import settle
from lodestrata.operators.datalog import evaluate
from lodestrata.plans import documents, fact_checks, findings
from lodestrata.sources.fact_text import scan

# ---- Datalog text over the facts of the driver tables

PATHS = """
.decl path(x: Call, y: Call)
.output path
path(x, y) :- call_unconditional(x, y).
path(x, y) :- call_conditional(x, y, _).
path(x, z) :- path(x, y), path(y, z).   // non-linear
"""
RISKY = """
.output risky
risky(c, k, "checked") :-
  call(c, a), call_effect(c, k), (k = "proc_exec"; contains("write", k)),
  !action_gate(a, "human_approval"), !call_region_secret(c), a != "7".
loop(c) :- call_unconditional(c, d), call_unconditional(d, c).
risky(c, "loop", m) :- loop(c), m = "cycle".
"""
PROGRAMS = {
    "dl_paths": (PATHS, "path", ("call_unconditional", "call_conditional"), "c1 c2"),
    "dl_risky": (RISKY, "risky", ("call", "call_effect", "action_gate", "call_region_secret", "call_unconditional"), "c kind note"),
}


def _program(name: str, relation: Callable) -> Callable[[SparkSession, str], DataFrame]:
    text, target, base, columns = PROGRAMS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        program = parse_text(text)
        given = {r: relation(spark, sf_dir, r) for r in base}
        known = evaluate(spark, program, {r: df.select(*df.columns) for r, df in given.items()})
        return known[target, len(columns.split())].toDF("p", *columns.split())

    return run


# ---- facts as text: one program per five customers, with planted defects

_LINES = """
SELECT CAST(floor(o_custkey / 5) AS BIGINT) AS p, o_orderkey AS ok, CASE
  WHEN o_orderkey % 13 = 0 THEN concat('call("', o_orderkey, '", "a', o_custkey, '")')
  WHEN o_orderkey % 17 = 0 THEN concat('called("', o_orderkey, '").')
  WHEN o_orderkey % 19 = 0 THEN concat('call("', o_orderkey, '").')
  WHEN o_orderkey % 23 = 0 THEN concat('call(', o_orderkey, ', "a', o_custkey, '"). // first\ncall("', o_orderkey, '", " a', o_custkey, ' ").')
  WHEN o_orderkey % 7 = 0 THEN concat('call("', o_orderkey, '", "a', o_custkey, '").\ncall_evidence_text("', o_orderkey, '", "a, (\\\\"quoted\\\\") // part").')
  ELSE concat('call("', o_orderkey, '", "a', o_custkey, '").') END AS line
FROM orders
"""
_CASES = """
SELECT o_custkey // 5 AS p, o_orderkey AS ok, CASE WHEN o_orderkey % 13 = 0 THEN 'broken' WHEN o_orderkey % 17 = 0 THEN 'unknown' WHEN o_orderkey % 19 = 0 THEN 'short'
  WHEN o_orderkey % 23 = 0 THEN 'twice' WHEN o_orderkey % 7 = 0 THEN 'quoted' ELSE 'plain' END AS k FROM orders
"""


def fact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet"))
    joined = lines.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ok", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(F.col("p") % 10 != 0, F.concat(F.lit('#include "library.dl"\nskill("s'), F.col("p").cast("string"), F.lit('").\n'))).otherwise(F.lit(""))
    return joined.select("p", F.concat(head, "body").alias("text"))


def fact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(fact_texts(spark, sf_dir)).groupBy("p", "class").agg(F.count("*").alias("n"), F.sum(F.size("args")).alias("n_args"))


def fact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fact_texts(spark, sf_dir)
    issues = fact_checks.text_issues(scan(texts), texts.select("p"), library="library.dl", evidence=True)
    return issues.groupBy("p", "code", "severity").agg(F.count("*").alias("n"))


def fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fact_texts(spark, sf_dir)
    return fact_checks.support_coverage(scan(texts), texts.select("p"))


_SKILLED = "SELECT DISTINCT o_custkey // 5 AS p FROM orders WHERE (o_custkey // 5) % 10 <> 0"
FACT_SQL = {
    "fact_classes": f"""WITH k AS ({_CASES}) SELECT p, class, count(*) AS n, sum(n_args) AS n_args FROM (
        SELECT p, CASE WHEN k IN ('broken', 'unknown') THEN 'unknown' ELSE 'core' END AS class, CASE WHEN k IN ('broken', 'unknown', 'short') THEN 1 ELSE 2 END AS n_args FROM k
        UNION ALL SELECT p, 'core', 2 FROM k WHERE k = 'twice' UNION ALL SELECT p, 'text', 2 FROM k WHERE k = 'quoted'
        UNION ALL SELECT p, c, 1 FROM ({_SKILLED}), (VALUES ('core'), ('include')) v(c)) GROUP BY p, class""",
    "fact_issues": f"""WITH k AS ({_CASES}) SELECT p, code, CASE WHEN code LIKE 'EVD%' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM (
        SELECT p, CASE k WHEN 'broken' THEN 'SDL001' WHEN 'unknown' THEN 'SDL002' WHEN 'short' THEN 'SDL003' WHEN 'twice' THEN 'SDL030' END AS code FROM k WHERE k IN ('broken', 'unknown', 'short', 'twice')
        UNION ALL SELECT p, 'EVD012' FROM k WHERE k IN ('short', 'twice', 'plain') UNION ALL SELECT p, 'EVD012' FROM k WHERE k = 'twice' UNION ALL SELECT p, 'EVD012' FROM ({_SKILLED})
        UNION ALL SELECT DISTINCT p, c FROM k, (VALUES ('SDL004'), ('SDL005')) v(c) WHERE p % 10 = 0) GROUP BY p, code""",
    "fact_support": f"""WITH k AS ({_CASES}), f AS (SELECT p, CASE WHEN k = 'quoted' THEN 1 ELSE 0 END AS hit FROM k WHERE k NOT IN ('broken', 'unknown') UNION ALL SELECT p, 0 FROM k WHERE k = 'twice' UNION ALL SELECT p, 0 FROM ({_SKILLED}))
        SELECT a.p, round(coalesce(c, 1.0), 6) AS coverage FROM (SELECT DISTINCT p FROM k) a LEFT JOIN (SELECT p, sum(hit)::DOUBLE / count(*) AS c FROM f GROUP BY p) b ON a.p = b.p""",
}

# ---- every check code: small programs of customers, each with one planted defect by its number

_SOUND = """skill("s").
action("a", "s").
call("c1", "a").
call("c2", "a").
call_unconditional("c1", "c2").
value("v", "a", "local").
call_input("c1", "v").
"""
#: Lines beside the sound ones, and the codes that they bring.
DEFECTS = [
    ("", ""),
    ('call("c3" "a"', "SDL001"),
    ('called("x").', "SDL002"),
    ('call("c9").', "SDL003"),
    ('skill("t").', "SDL005"),
    ('action("b", "t").', "SDL010"),
    ('action_trigger("q", "llm").', "SDL011"),
    ('call("c3", "q").', "SDL012"),
    ('call_effect("z", "stdout").', "SDL013"),
    ('call_unconditional("c2", "z").', "SDL014"),
    ('call_action("c1", "q").', "SDL015"),
    ('value("w", "q", "local").', "SDL016"),
    ('value_secret_allowed_action("w", "a").', "SDL017"),
    ('value_secret_allowed_action("v", "q").', "SDL018"),
    ('call_effect("c1", "fly").', "SDL020"),
    ('action_trigger("a", "never").', "SDL021"),
    ('skill_doc_claim("s", "safe").', "SDL022"),
    ('value("w", "a", "odd").', "SDL023"),
    ('call_code("c1", "none").', "SDL024"),
    ('action_gate("a", "none").', "SDL025"),
    ('call_input("c1", "v").', "SDL030"),
    ('action("b", "s").\ncall("d", "b").\ncall_unconditional("c1", "d").', "SDL031"),
    ('call_unconditional("c2", "c1").', "SDL032"),
    ('call("c3", "a").\ncall("c4", "a").\ncall_conditional("c3", "c4", "v").\ncall_conditional("c4", "c3", "v").', "SDL033"),
    ('call_output("c1", "w").', "SDL040"),
    ('value("w", "a", "secret").', "SDL050"),
    ('value("w", "a", "secret").\nvalue("w", "a", "sensitive_local").', "SDL051"),
    ('call_region_untrusted("c1").\ncall_region_sensitive("c1").', "SDL060"),
    ('call_region_untrusted("c1").\ncall_region_secret("c1").', "SDL061"),
    ('evidence_unit("su_0", 0).\ncall_evidence("c1", "su_9").', "EVD010"),
    ('call_evidence("c9", "su_0").', "EVD011"),
    ('call("d", "a").\ncall("d", "b").\naction("b", "s").\ncall_unconditional("c1", "d").', "SDL031"),
]
_CHECKS = ("check_fk", "check_enum", "check_cross", "check_root", "check_unreachable", "check_value_defined", "check_policy", "check_conflict")


def audit_codes(spark: SparkSession, sf_dir: str, audit: Callable) -> DataFrame:
    """(p, code, n): issues of each program, warnings of missing evidence aside."""
    p = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select(F.floor(F.col("o_custkey") / 5).cast("long").alias("p")).distinct()
    lines = F.array(*(F.lit(_SOUND + text) for text, _ in DEFECTS))
    texts = p.select("p", F.element_at(lines, (F.col("p") % len(DEFECTS) + 1).cast("int")).alias("text"))
    facts = settle(scan(texts))
    found = fact_checks.text_issues(facts, texts.select("p")).where("code <> 'EVD012'").select("p", "code")
    for name in _CHECKS:
        found = found.unionByName(audit(facts, name).select("p", "code"))
    return found.groupBy("p", "code").agg(F.count("*").alias("n"))


CODES_SQL = {
    "audit_codes": f"""SELECT p, code, 1 AS n FROM (SELECT DISTINCT o_custkey // 5 AS p FROM orders)
        JOIN (VALUES {", ".join(f"({i}, '{code}')" for i, (_, code) in enumerate(DEFECTS))}) v(i, code) ON p % {len(DEFECTS)} = i WHERE code <> ''""",
}

# ---- alignment: turns of users are the quotes, turns of assistants the units of a conversation


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select(F.col("conv_id").alias("p"), "turn", "role", "text")
    return turns.where("role = 'user'").select("p", F.col("turn").alias("e"), "text"), turns.where("role = 'assistant'").select("p", F.col("turn").alias("id"), "text")


def align_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(*_turns(spark, sf_dir)).withColumn("score", F.round("score", 6))


def align_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, units = _turns(spark, sf_dir)
    return alignment.alignment_metrics(alignment.align(evidence, units), units)


def _sql_tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{alignment.TOKEN}'), lambda x: lower(x))"


_LOW = r"lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))"
_PREP = f"SELECT *, {_LOW} AS low, {_sql_tokens(_LOW)} AS toks, len({_sql_tokens('text')}) AS own FROM"
_ALIGNED = f"""t AS ({_PREP} (SELECT conv_id AS p, turn, role, text FROM conversations)), d AS (SELECT *, list_distinct(toks) AS ds, len(toks) AS nt, len(list_distinct(toks)) AS nd FROM t),
 q AS (SELECT a.p, a.turn AS e, b.turn AS id, a.own AS ao, b.own AS bo, a.nd AS n, b.nd AS m, len(list_intersect(a.ds, b.ds)) AS s, least(a.nt, b.nt) AS sh, greatest(a.nt, b.nt) AS lo,
  (contains(b.low, a.low) OR contains(a.low, b.low)) AND least(length(a.low), length(b.low)) >= 8 AND least(a.nd, b.nd) >= 2 AS ins FROM d a JOIN d b ON a.p = b.p AND a.role = 'user' AND b.role = 'assistant'),
 z AS (SELECT *, CASE WHEN n = 0 OR m = 0 THEN 0.0::DOUBLE WHEN ins THEN CASE WHEN sh = lo THEN 1.0 ELSE greatest(0.75, sh::DOUBLE / lo) END
  WHEN n >= 3 AND s::DOUBLE / n >= 0.5 THEN greatest(s::DOUBLE / (n + m - s), s::DOUBLE / n * 0.75) ELSE s::DOUBLE / (n + m - s) END AS score FROM q),
 w AS (SELECT *, row_number() OVER (PARTITION BY p, e ORDER BY score DESC, id) AS nth FROM z),
 aligned AS (SELECT u.p, u.turn AS e, coalesce(w.score, 0.0::DOUBLE) AS score, coalesce(w.score >= CASE WHEN ao = 0 OR bo = 0 OR ao >= bo THEN 0.2::DOUBLE ELSE 0.2::DOUBLE * greatest(0.5::DOUBLE, ao::DOUBLE / bo) END, false) AS matched, w.id
  FROM (SELECT * FROM t WHERE role = 'user') u LEFT JOIN w ON w.p = u.p AND w.e = u.turn AND w.nth = 1)"""
ALIGN_SQL = {
    "align_best": f"WITH {_ALIGNED} SELECT p, e, round(score, 6) AS score, matched, CASE WHEN matched THEN id END AS unit_id FROM aligned",
    "align_metrics": f"""WITH {_ALIGNED}, r AS (SELECT p, avg(matched::INT) AS rate FROM aligned GROUP BY p), h AS (SELECT DISTINCT p, id FROM aligned WHERE matched),
     v AS (SELECT u.p, sum(CASE WHEN h.id IS NOT NULL THEN greatest(1, own) ELSE 0 END)::DOUBLE / sum(greatest(1, own)) AS share FROM t u LEFT JOIN h ON h.p = u.p AND h.id = u.turn WHERE role = 'assistant' GROUP BY u.p)
     SELECT coalesce(r.p, v.p) AS p, round(coalesce(rate, 0.0), 6) AS match_rate, round(coalesce(share, 0.0), 6) AS unit_coverage, round(coalesce(rate, 0.0) * coalesce(share, 0.0), 6) AS grounding FROM r FULL JOIN v ON r.p = v.p""",
}

# ---- documents: a conversation is a directory, each turn a file


_PATH = "CASE WHEN turn = 0 THEN 'SKILL.md' ELSE concat(CASE turn % 3 WHEN 0 THEN 'src/' WHEN 1 THEN '' ELSE 'build/' END, 't', CAST(turn AS STRING), CASE turn % 4 WHEN 0 THEN '.sh' WHEN 1 THEN '.txt' WHEN 2 THEN '.bin' ELSE '.d.ts' END) END"


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("p"), F.expr(_PATH).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def doc_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.inventory(turn_files(spark, sf_dir)).drop("content", "text")


def doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.content_hash(documents.inventory(turn_files(spark, sf_dir)))


def doc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.source_map(documents.merged_lines(documents.inventory(turn_files(spark, sf_dir))))


def doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the whole texts of ``documents``, line by line."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    made = units(docs.select(F.col("doc_id").alias("p"), F.lit("text.txt").alias("path"), F.lit("text").alias("language"), "text"))
    return made.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.max("line_end").alias("last_line"), F.max("id").alias("last_id"))


_LISTED = f"""listed AS (SELECT p, path, size_bytes, lang AS language, CASE WHEN lang = 'unknown' OR path LIKE '%.d.ts' THEN 'excluded' WHEN path = 'SKILL.md' THEN 'inlined' ELSE 'inlined_source' END AS disposition, body,
   CASE WHEN body = '' THEN 0 ELSE len(string_split(rtrim(body, chr(10)), chr(10))) END AS n FROM
   (SELECT conv_id AS p, {_PATH} AS path, coalesce(text, '') AS body, strlen(coalesce(text, '')) AS size_bytes, CASE WHEN turn = 0 THEN 'markdown' WHEN turn % 4 = 0 THEN 'shell' WHEN turn % 4 = 1 THEN 'text' WHEN turn % 4 = 2 THEN 'unknown' ELSE 'typescript' END AS lang
    FROM conversations WHERE turn = 0 OR turn % 3 <> 2))"""
DOC_SQL = {
    "doc_inventory": f"WITH {_LISTED} SELECT p, path, size_bytes, language, disposition, CASE WHEN disposition = 'excluded' THEN 0 ELSE n END AS line_count FROM listed",
    "doc_hash": f"WITH {_LISTED} SELECT p, sha256(string_agg(concat(path, chr(0), disposition, chr(0), CASE WHEN disposition = 'excluded' THEN size_bytes::VARCHAR ELSE body END, chr(0)), '' ORDER BY path)) AS sha256 FROM listed GROUP BY p",
    "doc_map": f"""WITH {_LISTED}, f AS (SELECT p, path, disposition, CASE WHEN rtrim(body) = '' THEN 0 ELSE len(string_split(regexp_replace(body, '[\\s]+$', ''), chr(10))) END AS m FROM listed WHERE disposition <> 'excluded'),
     runs AS (SELECT p, 0 AS b, '' AS k, 0 AS i, path AS source_file, m, 1 AS s FROM f WHERE disposition = 'inlined' AND m > 0 UNION ALL SELECT DISTINCT p, 1, '', 0, '{documents.GENERATED}', 3, 0 FROM f WHERE disposition <> 'inlined'
      UNION ALL SELECT p, 2, CASE WHEN contains(path, '/') THEN '1' ELSE '0' END || path, i, path, CASE i WHEN 0 THEN CASE WHEN m = 0 THEN 5 ELSE 3 END WHEN 1 THEN m ELSE 2 END, CASE WHEN i = 1 THEN 1 ELSE 0 END FROM f, (VALUES (0), (1), (2)) v(i) WHERE disposition <> 'inlined' AND (i = 0 OR m > 0))
     SELECT p, e - m + 1 AS line_start, e AS line_end, source_file, s AS source_start, CASE WHEN s = 0 THEN 0 ELSE m END AS source_end FROM (SELECT *, sum(m) OVER (PARTITION BY p ORDER BY b, k, i) AS e FROM runs)""",
    "doc_units": r"""SELECT p, count(*) AS n, sum(length(u)) AS n_chars, max(i) AS last_line, count(*) - 1 AS last_id FROM (SELECT doc_id AS p, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i, regexp_replace(l, '^\s+|\s+$', '', 'g') AS u FROM documents WHERE text IS NOT NULL) WHERE u <> '' GROUP BY p""",
}

# ---- reports


def _finding_queries(listed: Callable, first: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "finding_facts": lambda spark, sf_dir: findings.finding_facts(listed(spark, sf_dir)),
        "finding_rules": lambda spark, sf_dir: first(spark, sf_dir).select("p", "label", findings.level().alias("level"), F.col("n").alias("n_results")),
        "finding_first": lambda spark, sf_dir: first(spark, sf_dir).select("p", "label", F.array_join("fields", "|").alias("fields")),
    }


def _finding_sql(clause: Callable) -> dict[str, str]:
    head = clause("findings_all")
    numbered = "(SELECT p, label, fields, row_number() OVER (PARTITION BY p ORDER BY label, string_split(fields, '|')) - 1 AS nth FROM findings_all)"
    return {
        "finding_facts": head + f"SELECT p, nth, concat('finding(\"f', nth, '\", \"', label, '\", \"', replace(fields, '|', '\", \"'), '\").') AS line FROM {numbered}",
        "finding_rules": head + "SELECT p, label, 'warning' AS level, count(*) AS n_results FROM findings_all GROUP BY p, label",
        "finding_first": head + "SELECT p, label, fields FROM (SELECT p, label, fields, row_number() OVER (PARTITION BY p, label ORDER BY string_split(fields, '|')) AS k FROM findings_all) WHERE k = 1",
    }


def queries(relation: Callable, findings_of: Callable, first_findings_of: Callable, audit: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (fact_classes, fact_issues, fact_support, align_best, align_metrics, doc_inventory, doc_hash, doc_map, doc_units)}
    return {n: _program(n, relation) for n in PROGRAMS} | own | _finding_queries(findings_of, first_findings_of) | {"audit_codes": lambda spark, sf_dir: audit_codes(spark, sf_dir, audit)}


def oracle_sql(clause: Callable) -> dict[str, str]:
    return {
        "dl_paths": clause("call_before") + "SELECT p, v1 AS c1, v2 AS c2 FROM call_before",
        "dl_risky": clause("call", "call_effect", "action_gate", "call_region_secret", "call_unconditional")
        + """SELECT DISTINCT k.p, k.c, e.kind, 'checked' AS note FROM call k JOIN call_effect e ON e.p = k.p AND e.c = k.c WHERE (e.kind = 'proc_exec' OR e.kind LIKE '%write%') AND k.a <> '7'
          AND NOT EXISTS (SELECT 1 FROM action_gate g WHERE g.p = k.p AND g.a = k.a AND g.kind = 'human_approval') AND NOT EXISTS (SELECT 1 FROM call_region_secret r WHERE r.p = k.p AND r.c = k.c)
          UNION SELECT x.p, x.c1, 'loop', 'cycle' FROM call_unconditional x JOIN call_unconditional y ON x.p = y.p AND x.c2 = y.c1 AND x.c1 = y.c2""",
    } | FACT_SQL | CODES_SQL | ALIGN_SQL | DOC_SQL | _finding_sql(clause)
