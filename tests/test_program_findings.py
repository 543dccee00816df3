"""Findings made program by program are those that the rules' joins make, and nothing larger than the facts is written."""

import pytest

from lodestrata.operators import closure, program_findings
from lodestrata.plans import catalog, extras
from lodestrata.sources.table_facts import order_facts

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def by_program(spark):
    before = len(closure.SETTLED)
    found = catalog.relation(spark, SF, "findings_all")
    return rows(found), [spark.read.parquet(p).count() for p in closure.SETTLED[before:]]


def test_programs_of_many_facts_go_by_joins(spark, by_program, monkeypatch):
    monkeypatch.setattr(program_findings, "MAX_FACTS", 300)
    assert rows(catalog.relation(spark, SF, "findings_all")) == by_program[0]


def test_no_table_outgrows_the_facts(spark, by_program):
    facts = spark.read.parquet(f"{SF}/orders.parquet").count() + spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert max(by_program[1]) <= 4 * facts


def test_first_findings_and_counts(spark, by_program):
    first = {}
    for p, label, fields, _ in by_program[0]:
        first.setdefault((p, label), []).append(fields.split("|"))
    found = extras._finding_queries(catalog.findings_of, catalog.first_findings_of)
    assert {(r.p, r.label): r.fields.split("|") for r in found["finding_first"](spark, SF).collect()} == {k: min(v) for k, v in first.items()}
    assert {(r.p, r.label): r.n_results for r in found["finding_rules"](spark, SF).collect()} == {k: len(v) for k, v in first.items()}


def test_only_orders_are_written(spark, by_program):
    assert max(by_program[1]) <= spark.read.parquet(f"{SF}/orders.parquet").count()


def test_facts_of_orders_are_those_of_the_sql(spark, tmp_path):
    """Also with nulls, repeated keys and negative ones."""
    import datetime

    day = datetime.datetime(2024, 1, 1)
    orders = [(ok, cust, day + datetime.timedelta(days=ok or 0)) for cust in range(-12, 40) for ok in range(cust * 7, cust * 7 + 9)]
    orders += [(None, 3, day), (70, 5, day), (70, 5, day), (71, None, day), (7, 7, None), (630, 56, day), (631, 56, day), (None, 63, day), (640, 63, day)]
    items = [(ok, part, line) for ok in range(-90, 290) for part, line in ((ok * 3, ok), (ok + 1, 2), (-ok, 1))] + [(70, None, 1), (None, 4, 1), (72, 5, None), (630, 3, 0), (631, 7, 1), (630, 15, 1), (640, 8, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    tables, dealt, sizes = catalog._dealt(spark, str(tmp_path))
    found, most = set(), {r.p: r.n for r in sizes.collect()}
    for r in program_findings.packed(dealt).collect():
        own = {(r.p, *f) for f in order_facts(r.p, [tuple(o) for o in r.orders], program_findings.NUMBER)}
        assert len(own) <= most[r.p] + 7 * len({o.cust for o in r.orders})
        found |= own
    steps = list(dict.fromkeys(y for x in program_findings.READ for y in catalog.order(x) if y not in tables))
    made = catalog._relations(spark, dict(tables), steps, {"orders_", "items_"})
    assert found == {tuple(r) for df in program_findings.rows_of(made) for r in df.collect()}


def test_orders_are_joined_to_items_by_rounds(spark, tmp_path, monkeypatch):
    """A round holds a part of all orders, also where keys differ in type, are null or stand twice; what comes before and after an order is as in one round."""
    spark.createDataFrame([(ok if ok % 90 else None, cust, day) for cust in range(40) for day, ok in enumerate([cust * 9, *range(cust * 9, cust * 9 + 9)])], "o_orderkey int, o_custkey long, o_orderdate int").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(ok, ok * 7 + i, i) for ok in range(360) for i in range(ok % 4)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes, deal = [], catalog.settle_dealt

    def counted(rounds, parts):
        rounds = list(rounds)
        sizes.append([df.count() for df in rounds])
        return deal(rounds, parts)

    monkeypatch.setattr(catalog, "settle_dealt", counted)
    key = lambda r: tuple((x is None, x) for x in r)
    found = []
    for most in (1_000, 100):
        monkeypatch.setattr(catalog, "ROUND_ORDERS", most)
        found.append(sorted((tuple(r) for r in catalog._dealt(spark, str(tmp_path))[1].collect()), key=key))
    assert [len(x) for x in sizes] == [1, 4] and sum(sizes[1]) == 400 and max(sizes[1]) < 200
    spark.read.parquet(f"{tmp_path}/orders.parquet").createOrReplaceTempView("orders")
    of_sql = sorted((tuple(r) for r in spark.sql(catalog.FACTS["orders_"]).collect()), key=key)
    spark.catalog.dropTempView("orders")
    assert found[0] == found[1] and sorted((r[:5] for r in found[1]), key=key) == of_sql
    assert sum(bin(r[5] or 0).count("1") for r in found[1]) > 300
