"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from kgloom.plans.all import ORACLE_SQL, QUERIES
from kgloom.session import TABLES

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
