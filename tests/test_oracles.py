"""Every query with a SQL oracle gives the oracle's rows at the smallest scale."""

import os

import duckdb
import pytest

from landmesh.plans.catalog import ORACLE, QUERIES
from oracle_check import TABLES, rows_of

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    got = df.collect()
    if name in ORACLE:
        rel = duck.execute(ORACLE[name])
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of(cols, rel.fetchall())
