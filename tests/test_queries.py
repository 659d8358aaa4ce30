"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom.plans import ORACLES, QUERIES, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in out.collect())
    assert got == sorted(repr([normal(v) for v in row]) for row in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_more_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(registry, "LINES_A_TASK", 100)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert registry.records(spark, SF).rdd.getNumPartitions() == -(-lines // 100)
    plan = QUERIES["feature_set_projection"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # one task does not hold a join for each set


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_description_does_not_depend_on_how_lines_are_dealt(spark, monkeypatch):
    want = sorted(repr(r) for r in QUERIES["describe_overall_and_by_label"](spark, SF).collect())
    monkeypatch.setattr(registry, "LINES_A_TASK", 200)
    assert sorted(repr(r) for r in QUERIES["describe_overall_and_by_label"](spark, SF).collect()) == want


def test_few_order_lines_meet_in_a_task():
    """A task's memory follows this number until the tables have more than twelve times as many lines."""
    assert registry.LINES_A_TASK <= 200_000
