"""Configurations in YAML, validation, sinks and a build that goes on where it stopped."""

import json
import os

import pytest
from pyspark.sql import functions as F

from landmesh import constants as C
from landmesh.operators import build as B
from landmesh.operators import polygons as G
from landmesh.operators import validate as V
from landmesh.operators.resistance import TableError
from landmesh.operators.solve import perturbed_table
from landmesh.sources import config as Y
from landmesh.sources import sinks as W

GOOD = """table_id: {name}
r_max: 100.0
base: landcover
landcover: {{10: 1, 20: 2, 30: 3, 40: 4, 50: 50, 60: 6, 70: 7, 80: 80, 90: 9, 95: 5, 100: 10}}
slope: {{per_degree: 0.02}}
elevation_bands: [{{max_m: 500.0, factor: 1.0}}, {{max_m: 2000.0, factor: 2.0}}]
roads: {{by_class: {{1: 20, 5: 1}}}}
water: {{mode: barrier, value: 50}}
"""


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_tables_are_loaded_by_id(tmp_path):
    put(tmp_path, "b.yaml", GOOD.format(name="first"))
    put(tmp_path, "a.yaml", GOOD.format(name="second"))
    got = Y.load_tables(str(tmp_path))
    assert list(got) == ["second", "first"] and got["first"]["slope"] == (0.02, 45.0) and got["first"]["buffer_m"] == 50.0
    assert got["first"]["water"] == ("barrier", 50.0) and len(got["first"]["provenance"]["sha256"]) == 64
    put(tmp_path, "c.yaml", GOOD.format(name="first"))
    with pytest.raises(TableError, match="twice"):
        Y.load_tables(str(tmp_path))
    assert {"montane", "modified"} <= set(Y.load_tables())


@pytest.mark.parametrize("old, new", [
    ("10: 1,", ""), ("50: 50", "50: 500"), ("10: 1,", "10: 0,"), ("r_max: 100.0", "r_max: 1.0"), ("r_max: 100.0", "r_max: much"), ("base: landcover", "base: ghm"), ("base: landcover", "base: other"),
    ("by_class: {1: 20", "by_class: {7: 20"), ("value: 50", "value: null"), ("mode: barrier", "mode: lake"), ("max_m: 500.0", "max_m: 5000.0"), ("per_degree: 0.02", "per_degree: -1"), ("factor: 2.0", "factor: 0"), ("table_id: x", "note: x"),
])
def test_broken_tables_are_refused(tmp_path, old, new):
    text = GOOD.format(name="x")
    assert old in text
    put(tmp_path, "a.yaml", text.replace(old, new))
    with pytest.raises(TableError):
        Y.load_tables(str(tmp_path))


def test_a_perturbed_table_is_written_once(tmp_path):
    path = str(tmp_path / "random.yaml")
    made = perturbed_table(C.TABLES["large_mammal"], 5)
    digest = Y.write_table(made, "random", path)
    assert Y.write_table(perturbed_table(C.TABLES["large_mammal"], 6), "random", path) == digest
    back = Y.load_tables(str(tmp_path))["random"]
    assert back["landcover"] == made["landcover"] and back["roads"] == made["roads"] and back["slope"] == made["slope"] and back["water"] == made["water"]


def test_sources_scale_with_the_tier(tmp_path):
    c = Y.load_sources()
    big = Y.for_tier(c, "L")
    assert big["points"]["min_separation_px"] == 4 * c["points"]["min_separation_px"] and big["regions"]["min_patch_px"] == 16 * c["regions"]["min_patch_px"]
    assert big["points"]["k_range"] == c["points"]["k_range"] and Y.for_tier(c, "none") == c and len(c["sha256"]) == 64
    with pytest.raises(ValueError):
        Y.load_sources(put(tmp_path, "x.yaml", "config_id: x\npoints: {k_range: [5, 3]}"))
    put(tmp_path, "small.yaml", "cpus_per_task: 4\nmem_gb: 8\n")
    assert Y.spark_settings(Y.profile("small", str(tmp_path))) == {"spark.executor.cores": "4", "spark.executor.memory": "8g"}
    with pytest.raises(FileNotFoundError):
        Y.profile("large", str(tmp_path))
    p = Y.presets()
    assert p["four_neighbours"].four and p["exact"].method == "direct"
    with pytest.raises(ValueError):
        Y.Preset.load(put(tmp_path, "p.yaml", "preset_id: p\nsolver: other"))


def test_errors_of_datasets(spark):
    configs = spark.createDataFrame([(1, "points", "points", 8, 8), (2, "omniscape", "omniscape", 8, 8), (3, "x", "other", 8, 8)], "sample_id bigint, config string, kind string, h int, w int")
    rows = [(1, "points", n, t, 8 if n in C.RASTERS else 3, 8 if n in C.RASTERS else 3, 0) for n, t in C.DATASETS["points"].items()]
    rows += [(2, "omniscape", "source_strength", "float64", 8, 4, 7), (2, "omniscape", "cum_current", "float32", 8, 8, 0), (2, "omniscape", "normalized", "float32", 8, 8, 0)]
    found = spark.createDataFrame(rows, "sample_id bigint, config string, dataset string, dtype string, h int, w int, n_bad int")
    got = {tuple(r) for r in V.datasets(configs, found).collect()}
    assert got == {(2, "omniscape", "source_strength", x) for x in ("dtype", "shape", "not_finite")} | {(2, "omniscape", "flow_potential", "missing"), (3, "x", None, "unknown_kind")}
    rep = {r.kind: r for r in V.report(configs, V.datasets(configs, found), "kind").collect()}
    assert rep["points"].ok and rep["omniscape"].n_errors == 4 and not rep["other"].ok


def test_points_on_holes_and_borders(spark):
    ring = lambda name, pts: [(name, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]
    edges = spark.createDataFrame(ring("b", [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)]) + ring("b", [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]) + ring("a", [(25.0, 25.0), (50.0, 25.0), (50.0, 50.0)]), "poly string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 15.0), (3, 29.0, 26.0), (4, 60.0, 5.0), (5, 5.0, 0.0)], "id bigint, x double, y double")
    assert {r.id: r.poly for r in G.within(p, edges, 7.0).collect()} == {1: "b", 3: "a", 5: "b"}


def test_schema_pages_and_cards(spark):
    t = spark.createDataFrame([(1, "x", None)], "id bigint, name string, parts array<int>")
    page = W.schema_page("things", t.schema, {"id": "a number"})
    assert page.startswith("# things\n") and "| `id` | bigint | optional | a number |" in page and "array<int>" in page
    card = json.loads(json.dumps(W.card("c", "1", "http://l", {"things": t.schema}, {"things": "t/*.parquet"})))
    assert [f["dataType"] for f in card["recordSet"][0]["field"]] == ["sc:Integer", "sc:Text", "sc:Text"] and card["distribution"][0]["includes"] == "t/*.parquet"


def test_a_build_goes_on_where_it_stopped(spark, tmp_path):
    root = f"file://{tmp_path}/build"
    B.plan(spark.range(6).select((F.col("id") + 48).alias("seed")), root)
    assert {tuple(r) for r in B.status(spark, root).collect()} == {(0, 2, 0, 0, 0), (1, 4, 0, 0, 0)}
    assert B.prepare(spark, root, 8, 2) == 6 and B.prepare(spark, root, 8, 2) == 0
    os.system(f"rm -r {tmp_path}/build/inputs/shard=1")
    assert B.solve(spark, root) == 2 and B.prepare(spark, root, 8, 2) == 4
    assert B.solve(spark, root) == 4 and B.finalize(spark, root) == 6 and B.finalize(spark, root) == 0
    assert {tuple(r) for r in B.status(spark, root).collect()} == {(0, 2, 2, 2, 2), (1, 4, 4, 4, 4)}
    index = spark.read.parquet(f"{root}/index")
    assert index.where("n_pairs <> 1 OR residual > 1e-6 OR qc_flags <> ''").count() == 0


def test_pictures_and_wkt(spark):
    import numpy as np

    from landmesh.sources import images as M

    gray = np.arange(35).reshape(5, 7) * 7
    assert (M.pixels(M.png(gray)) == gray).all() and M.png(gray)[:8] == b"\x89PNG\r\n\x1a\n"
    t = spark.createDataFrame([("a", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 1.5, 1 1)), ((-5 -5, -4 -5, -4 -4, -5 -5)))")], "poly string, wkt string")
    e = G.edges_of_wkt(t).collect()
    assert len(e) == 9 and (e[0].x0, e[0].y0, e[0].x1, e[0].y1) == (0, 0, 4, 0) and {r.poly for r in e} == {"a"}
