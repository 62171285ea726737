"""Queries of the training-data operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from kgloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
