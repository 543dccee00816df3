"""Registered queries over the driver tables, and their SQL for DuckDB.

A query builds only the relations it needs, as temporary views; relations that
many others read are checkpointed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import program_findings
from lodestrata.operators.closure import reachable, settle, settle_dealt, transitive_closure
from lodestrata.plans.relations import _SECRET_NAMES, APART, BLOCKS, CLOSURES, DERIVED, FIELDS, REACH
from lodestrata.plans import extras
from lodestrata.sources.fact_text import relation_tables
from lodestrata.sources.table_facts import FACTS, ITEM_BITS, ITEM_FACTS, ORDER_FACTS

TABLES = ("orders", "lineitem")
#: Read by several relations of one query, so written once.
SHARED = {"orders_", "items_", "value_reaches", "call_reached", "acall", "call_in_untrusted_region", "untrusted_reached", "witness_1", "flow_base"}
SQL = FACTS | DERIVED


def needs(name: str, sql: dict[str, str] = SQL) -> list[str]:
    if name in REACH:
        return list(REACH[name])
    if name in CLOSURES:
        return [CLOSURES[name][0]]
    text = re.sub(r"'[^']*'", "''", sql[name])
    found = re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)
    return [x for x in dict.fromkeys(found) if x in SQL or x in REACH or x in CLOSURES]


def order(name: str, sql: dict[str, str] = SQL) -> list[str]:
    """What ``name`` is built from, itself last."""
    out: list[str] = []

    def visit(x: str) -> None:
        if x not in out:
            for y in needs(x, sql):
                visit(y)
            if x not in out:
                out.append(x)

    visit(name)
    return out


#: Relations whose rows outnumber all facts: they are made program by program.
WHOLE = ("findings_all", "label_summary", f"label_{program_findings.OVERREACH}")
#: Orders that one part of a table dealt by p holds about, and those that are joined to their items at once.
PART_ORDERS, ROUND_ORDERS = 50_000, 1_500_000


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the facts of the driver tables."""
    if name in WHOLE:
        df = _whole(spark, name, *_dealt(spark, sf_dir))
        return df.withColumn("fields", F.array_join("fields", "|")).select("p", "label", "fields", "severity") if name == "findings_all" else df
    return _build(spark, name, _driver_tables(spark, sf_dir), order(name))


def _driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES}


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings over the facts of the driver tables, their fields apart; ``nth`` is a finding's place in its program."""
    return _whole(spark, "findings_all", *_dealt(spark, sf_dir))


def first_findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding of each label and program, and the number ``n`` of them."""
    return _whole(spark, "first", *_dealt(spark, sf_dir))


def _dealt(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The driver tables, all orders with their items dealt by p, and how many facts each program has at most.

    Orders are joined to their items by rounds of order keys, as many as keep a round's shuffle files to those of
    ``ROUND_ORDERS``; what comes before and after an order is seen once a program's orders are together."""
    tables = _driver_tables(spark, sf_dir)
    n_orders = tables["orders"].count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_orders // PART_ORDERS))
    rounds = max(1, -(-n_orders // ROUND_ORDERS))

    def joined(i: int) -> DataFrame:
        mine = lambda table, key: tables[table].where(F.pmod(F.hash(F.col(key).cast("long")), F.lit(rounds)) == i) if rounds > 1 else tables[table]
        bits = spark.sql(ITEM_BITS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=mine("lineitem", "l_orderkey"))
        orders = mine("orders", "o_orderkey").where("o_custkey is not null").selectExpr("o_custkey as cust", "o_orderkey as ok", "o_orderdate as at")
        return orders.join(bits, F.col("ok") == F.col("item_of"), "left").select(F.expr("cast(floor(cust / 5) as bigint) as p"), "cust", "ok", "at", "items")

    own = "over (partition by p, cust order by at, ok)"  # as orders_ has it; p follows from cust
    orders = settle_dealt(map(joined, range(rounds)), parts).selectExpr("p", "cust", "ok", f"lead(ok) {own} as nx", f"lag(ok) {own} as pv", "items")
    size = F.lit(ORDER_FACTS) + ITEM_FACTS * F.coalesce(F.bit_count("items"), F.lit(0))
    return tables, orders, orders.groupBy("p").agg(F.sum(size).alias("n"))


def _whole(spark: SparkSession, name: str, given: dict[str, DataFrame], facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """A relation of ``WHOLE``, or the ``first`` findings of each label: by programs, those of very many facts by joins."""
    large = settle(sizes.where(F.col("n") > program_findings.MAX_FACTS).select("p"))
    some = not large.isEmpty()
    if some:
        facts = facts.join(F.broadcast(large), "p", "left_anti")
        own = lambda df: df if "p" in df.columns else df.withColumn("p", F.expr("cast(floor(o_custkey / 5) as bigint)"))
        kept = {t: own(df).join(F.broadcast(large), "p", "left_semi").select(*df.columns) if t != "lineitem" else df for t, df in given.items()}
        rest = lambda x: _build(spark, x, kept, [y for y in order(x) if y not in kept and (y not in FACTS or "orders" in kept)])
    rows = program_findings.packed(facts)
    of_rules = (_SECRET_NAMES, BLOCKS)
    if name == f"label_{program_findings.OVERREACH}":
        out = program_findings.label_rows(rows, program_findings.OVERREACH, FIELDS[name], *of_rules)
        return out.unionByName(rest(name)) if some else out
    first_only = name != "findings_all"
    out = program_findings.findings(rows, [x[6:] for x in FIELDS], *of_rules, first_only).withColumn("severity", F.lit("warning"))
    if some:
        found = rest("findings_all").select("*", F.expr("cast(row_number() over (partition by p order by label, fields) - 1 as long)").alias("nth"), F.expr("count(*) over (partition by p, label)").alias("n"), F.expr("row_number() over (partition by p, label order by fields)").alias("k"))
        out = out.unionByName((found.where("k = 1") if first_only else found).drop("k"))
    return out.groupBy("label").agg(F.sum("n").alias("n_findings"), F.count("p").alias("n_programs")) if name == "label_summary" else out


def audit(facts: DataFrame, name: str) -> DataFrame:
    """A relation over facts of any origin: rows ``p, relation, args`` (others are ignored), as of ``fact_text.scan``.

    ``check_single`` counts a program's skill facts as they stand, repeated ones and none included, which its SQL over
    distinct facts can't. Of a call's or value's repeated declarations that with the largest ``seq`` holds, where there is
    such a column, else the largest. The fields of ``findings_all`` are an array.
    """
    if name == "check_single":
        counted = facts.where("relation = 'skill'").groupBy("p").agg(F.count("*").alias("n"))
        n = F.coalesce("n", F.lit(0))
        return facts.select("p").distinct().join(counted, "p", "left").where(n != 1).select("p", F.lit("SDL005").alias("code"), n.cast("long").alias("n"))
    nth = F.col("seq") if "seq" in facts.columns else F.lit(0)
    last = lambda relation, size, at: (
        facts.where((F.col("relation") == relation) & (F.size("args") == size)).groupBy("p", F.col("args")[0].alias("id"))
        .agg(F.max(F.struct(nth.alias("nth"), F.col("args")[at].alias("x"))).alias("last")).select("p", "id", "last.x")
    )
    given = relation_tables(facts) | {
        "program": facts.select("p").distinct(), "call_home": last("call", 2, 1).toDF("p", "c", "a"), "value_kind": last("value", 3, 2).toDF("p", "v", "kind"),
    }
    if name in WHOLE:
        rows = reduce(DataFrame.unionByName, program_findings.rows_of(given))
        df = _whole(facts.sparkSession, name, given, rows, facts.groupBy("p").agg(F.count("*").alias("n")))
        return df.select("p", "label", "fields", "severity") if name == "findings_all" else df
    return _build(facts.sparkSession, name, given, [x for x in order(name) if x not in FACTS])


def _build(spark: SparkSession, name: str, given: dict[str, DataFrame], steps: list[str]) -> DataFrame:
    return given[name] if name in given else _relations(spark, given, steps, SHARED | set(REACH) | set(CLOSURES), name)[name]


def _relations(spark: SparkSession, given: dict[str, DataFrame], steps: list[str], shared: set[str], last: str | None = None) -> dict[str, DataFrame]:
    """Runs the steps over views of names of their own; a view is inlined where it is read, so all go at the end. Those that
    are ``shared`` are written, but for the ``last``."""
    made = dict(given)
    mark = f"v{uuid4().hex[:12]}_"
    known = {*given, *steps}
    views: list[str] = []

    def register(x: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(mark + x)
        views.append(mark + x)

    def own_names(sql: str) -> str:
        return re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: m[1] + m[2] + (f"{mark}{m[3]} AS {m[3]}" if m[3] in known and not _aliased(sql, m.end()) else mark + m[3] if m[3] in known else m[3]), sql)

    try:
        for x, df in given.items():
            register(x, df)
        for x in steps:
            if x == "findings_all":
                parts = [spark.table(mark + label).select("p", F.lit(label[6:]).alias("label"), F.array(*f.split()).alias("fields"), F.lit("warning").alias("severity")) for label, f in FIELDS.items()]
                df = reduce(DataFrame.unionByName, parts)
            elif x in REACH:
                df = reachable(*(spark.table(mark + r) for r in REACH[x]))
            elif x in CLOSURES:
                base, a, b = CLOSURES[x]
                df = transitive_closure(spark.table(mark + base).selectExpr("p", f"{a} as v1", f"{b} as v2"))
            else:
                df = spark.sql(own_names(SQL[x]))
            if x in shared and x != last:
                df = settle(df)
            register(x, df)
            made[x] = df
        return made
    finally:
        for v in views:
            spark.catalog.dropTempView(v)


def _aliased(sql: str, end: int) -> bool:
    """Whether a table's name that ends here is followed by an alias: a word in lower case."""
    return re.match(r"\s+[a-z]\w*", sql[end:]) is not None


def clause(*names: str) -> str:
    """The WITH clause that defines the relations and all they are built from, for DuckDB: relations of ``APART`` by their
    other text."""
    sql = SQL | APART
    parts = []
    for x in dict.fromkeys(y for name in names for y in order(name, sql)):
        if x in REACH:
            roots, edges = REACH[x]
            extra, own = (", v", ", r.v") if x == "passed" else ("", "")
            body = f"SELECT p, c{extra} FROM {roots} UNION SELECT e.p, e.c2{own} FROM {x} r JOIN {edges} e ON e.p = r.p AND e.c1 = r.c"
        elif x in CLOSURES:
            base, a, b = CLOSURES[x]
            body = f"SELECT p, {a} AS v1, {b} AS v2 FROM {base} UNION SELECT r.p, r.v1, e.{b} FROM {x} r JOIN {base} e ON e.p = r.p AND e.{a} = r.v2"
        else:
            body = sql[x]
        parts.append(f"{x} AS ({body})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def oracle(name: str) -> str:
    return clause(name) + f"SELECT * FROM {name}"


HIDDEN = {"orders_", "customers_", "items_", "inner_root", "used_value", "source_kind", "input_asked", "passed_on", "passed", "input_missing", "declared", "flow_pair", "acall", "call_before", "inner_edge", "untrusted_reached", "witness"} | {f"witness_{i}" for i in range(1, 6)} | {f"{k}_{x}" for k in ("untrusted", "sensitive", "secret") for x in ("start", "reach")}
NAMES = [n for n in [*(x for x in FACTS if x in ("call_action_arg", "value")), *DERIVED, *REACH, *CLOSURES] if n not in HIDDEN]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: lambda spark, sf_dir, n=n: relation(spark, sf_dir, n) for n in NAMES} | extras.queries(relation, findings_of, first_findings_of, audit)


def oracle_sql() -> dict[str, str]:
    return {n: oracle(n) for n in NAMES} | extras.oracle_sql(clause)
