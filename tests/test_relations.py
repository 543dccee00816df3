"""Fixpoint strategies agree with each other and with SQL; programs stay apart; registered queries match their SQL."""

import os

import pytest

from lodestrata.operators.closure import reachable, transitive_closure
from lodestrata.plans import catalog

PAIRS = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "x", "y"), (2, "b", "a"), (2, "q", "q")]


@pytest.mark.parametrize("strategy", ["grouped", "delta"])
def test_closure(spark, strategy):
    df = spark.createDataFrame(PAIRS, "p long, v1 string, v2 string")
    got = {tuple(r) for r in transitive_closure(df, strategy).collect()}
    want = {(1, x, y) for x in "abc" for y in "abc"} | {(1, "x", "y"), (2, "b", "a"), (2, "q", "q")}
    assert got == want


@pytest.mark.parametrize("strategy", ["grouped", "delta"])
def test_reach_stays_in_its_program(spark, strategy):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "b", "c")], "p long, c1 string, c2 string")
    roots = spark.createDataFrame([(1, "a"), (2, "z")], "p long, c string")
    assert {tuple(r) for r in reachable(roots, edges, strategy).collect()} == {(1, "a"), (1, "b"), (2, "z")}


def test_order_builds_before_use():
    names = catalog.order("findings_all")
    for i, n in enumerate(names):
        assert set(catalog.needs(n)) <= set(names[:i])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("name", ["edge", "reachable_call", "value_reaches", "label_summary", "check_fk", "metric_availability"])
def test_against_duckdb(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rows = con.sql(catalog.oracle(name))
    got = catalog.relation(spark, sf_dir, name).select(*rows.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows.fetchall()))
