"""Every text query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom.llm.queries import ORACLES, QUERIES
from tests.test_queries import SF, TABLES, normal


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in out.collect())
    assert got == sorted(repr([normal(v) for v in row]) for row in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
