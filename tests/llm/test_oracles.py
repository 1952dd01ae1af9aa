"""The queries that SQL can express against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df, rel = QUERIES[name](spark, DATA), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    by_name = lambda r: tuple(r[c] for c in sorted(rel.columns))
    assert sorted(map(by_name, df.collect()), key=repr) == sorted(map(by_name, want), key=repr)
