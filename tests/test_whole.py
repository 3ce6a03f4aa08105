"""Queries on small rasters and tiles take every row of their table, at the smallest scale."""

import os
import re

import duckdb
import pytest

from landmesh.plans.catalog import ORACLE, QUERIES
from oracle_check import TABLES

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
CUT = re.compile(r"\b(?:\w+\.)?(?:sid|c_custkey) (?:<|=) \d+")
#: Queries without an oracle; they return rows of every raster.
ROWS = ["G-10_pairwise_solve", "G-10b_pair_maps", "G-10c_cumulative_current", "G-11_advanced_solve", "G-12_moving_window", "G-13_gradient_iterations", "G-14_refinement", "G-09_bilinear_resample"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def test_oracles_take_whole_tables():
    assert not [n for n in ORACLE if CUT.search(ORACLE[n])]


@pytest.mark.parametrize("name", ROWS)
def test_all_rasters(spark, duck, name):
    n = duck.execute("SELECT count(DISTINCT vec_id) FROM embeddings").fetchone()[0]
    assert QUERIES[name](spark, BASE).select("sid").distinct().count() == n


def test_outlines_of_all_rasters(spark):
    assert QUERIES["A-26_region_outlines"](spark, BASE).agg({"sid": "max"}).first()[0] >= 60


def test_lines_of_all_tiles(spark):
    assert QUERIES["G-08_line_rasterisation"](spark, BASE).agg({"line": "max"}).first()[0] >= 60
