"""What showed only on large tables: joins that broadcast whole rasters, tasks too few, zeros' signs."""

import os
import re

import duckdb
import numpy as np
import pytest

from landmesh.operators import kernels as K
from landmesh.operators import polygons as P
from landmesh.operators import solve as S
from landmesh.plans.catalog import ORACLE, QUERIES
from oracle_check import rows_of

BASE = "/root/testdata/sf0.001"

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_resampling_meets_no_table_of_all_rasters(spark):
    values = np.random.default_rng(2).random((3, 8, 8))
    rows = [(s, r, c, None if (s, r, c) == (1, 0, 1) else float(values[s, r, c])) for s in range(3) for r in range(8) for c in range(8) if (s, r, c) != (2, 7, 7)]
    df = spark.createDataFrame(rows, "sid bigint, r bigint, c bigint, v double")
    got = P.resampled(df, "v", 8, 5)
    assert "sid" not in " ".join(re.findall(r"Join (\[.*)", plan(got)))
    seen = {(s, r, c): v for s, r, c, v in rows if v is not None}
    assert got.count() == 75
    for x in got.collect():
        ways = []
        for t in (x.tr, x.tc):
            at = (t + 0.5) * 1.6 - 0.5
            k = int(np.floor(at))
            ways.append([(min(max(k, 0), 7), 1 - (at - k)), (min(max(k + 1, 0), 7), at - k)])
        met = [(a * b, seen[x.sid, r, c]) for r, a in ways[0] for c, b in ways[1] if (x.sid, r, c) in seen]
        assert x.v == pytest.approx(sum(w * v for w, v in met) / sum(w for w, _ in met))


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_regenerated_cells_are_not_broadcast(spark):
    df = QUERIES["Y-14_regenerate"](spark, BASE)
    assert "Broadcast" not in plan(df) and "REPARTITION_BY_NUM" in plan(df)
    assert df.where("same AND cells = 1024").count() == df.count() > 0


def windows_case(rng, shape, n):
    r = 10 ** rng.uniform(0, 2, (n, *shape))
    source = np.where(rng.random(r.shape) > 0.2, rng.random(r.shape), 0.0)
    return r, rng.random(r.shape) > 0.25, source


@pytest.mark.parametrize("block,threshold,radius,shape", [(1, 0.0, 3, (8, 8)), (3, 0.2, 3, (8, 9)), (2, 0.5, 2, (7, 5)), (1, 0.0, 1, (4, 6))])
def test_windows_of_many_rasters_at_once(monkeypatch, block, threshold, radius, shape):
    r, valid, source = windows_case(np.random.default_rng(5), shape, 6)
    valid[:2] = True
    want = [K.moving_window(r[k], valid[k], source[k], radius, block, threshold) for k in range(6)]
    solves, real = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: solves.append(1) or real(*a))
    got = K.moving_windows(r, valid, source, radius, block, threshold)
    assert len(solves) <= 2 * shape[0] * shape[1]
    for k in range(6):
        flow = want[k]["potential"] > 1e-9
        assert np.allclose(got["cumulative"][k], want[k]["cumulative"]) and np.allclose(got["potential"][k], want[k]["potential"])
        assert np.allclose(got["normalized"][k][flow], want[k]["normalized"][flow])


def test_small_rasters_share_a_task_and_large_ones_do_not(spark):
    """Rasters of several shapes, far and near ids, rows left out; ids on both sides of a group's border."""
    rng, rows, want = np.random.default_rng(6), [], {}
    for sid, shape in ((-3, (8, 8)), (0, (8, 8)), (1, (5, 8)), (255, (8, 8)), (256, (8, 8)), (9000, (20, 6)), (2**40, (3, 3))):
        r, valid, source = (x[0] for x in windows_case(rng, shape, 1))
        valid[0] &= sid != 255
        out = K.moving_window(r, valid, source, 3)
        for i, j in np.ndindex(shape):
            if (sid, i) != (255, 0):  # a row that the table lacks
                rows.append((sid, i, j, float(r[i, j]), bool(valid[i, j]), float(source[i, j])))
                want[sid, i, j] = out["cumulative"][i, j], out["potential"][i, j]
    df = S.moving_window(spark.createDataFrame(rows, "sid bigint, r bigint, c bigint, resistance double, valid boolean, source double"), 3)
    got = {(x.sid, x.r, x.c): (x.cum_current, x.flow_potential) for x in df.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert "FlatMapGroupsInPandas [_small" in plan(df)


@pytest.mark.parametrize("name", ["LD-05_upper_triangle", "SNK-19_column_order"])
def test_arrays_keep_the_sign_of_zero(spark, tmp_path, name):
    """A negative value that rounds to zero is -0.0 for DuckDB; one in a million values is."""
    con = duckdb.connect()
    tiny = "CASE p % 5 WHEN 0 THEN -4e-7 WHEN 1 THEN 4e-7 WHEN 2 THEN -6e-7 WHEN 3 THEN '-0.0'::DOUBLE ELSE p * -0.01 END"
    con.execute(f"COPY (SELECT k AS vec_id, 1 AS label, CASE WHEN k < 2 THEN [CASE WHEN p = 9 AND k = 1 THEN NULL ELSE CAST({tiny} AS FLOAT) END FOR p IN range(64)] ELSE [CAST(0.5 AS FLOAT) FOR p IN range(64)] END AS embedding FROM range(3) t(k)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    rel = con.execute(ORACLE[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'"))
    cols = [x[0] for x in rel.description]
    df = QUERIES[name](spark, str(tmp_path))
    want = rows_of(cols, rel.fetchall())
    assert "-0.0," in "".join(want)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
