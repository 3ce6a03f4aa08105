"""Queries on synthetic fields, source configurations, loaders, validation and shard states."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import cells as C
from ..operators import kernels as N
from ..operators import solve as S
from ..operators import validate as V
from ..sources import fixtures as X
from .network import SMALL, _COMP, labelled, small
from .numeric import focal_cells, quota, quota_sql
from .registry import query
from .surfaces import SURFACE, surface

_TIERS = ", ".join(f"('{t}', {s})" for t, s in K.TIER_SIZE.items())


@query("P-29_tier_scaling", f"WITH t(tier, size) AS (VALUES {_TIERS}) SELECT tier, CAST(12 * size // 128 AS BIGINT) AS separation_px, CAST(25 * (size // 128) * (size // 128) AS BIGINT) AS min_patch_px, CAST(2 * size // 128 AS BIGINT) AS strip_px FROM t")
def tier_scaling(spark, d):
    t = spark.createDataFrame(list(K.TIER_SIZE.items()), "tier string, size bigint")
    scale = F.floor(F.col("size") / 128)
    return t.select("tier", (12 * scale).alias("separation_px"), (25 * scale * scale).alias("min_patch_px"), (2 * scale).alias("strip_px"))


# -- synthetic fields ---------------------------------------------------------------


def fields(spark, d, name: str, side: int = 16):
    """One named field for each seed, as cells: sid, r, c, f."""

    def run(batches):
        for pdf in batches:
            for seed in pdf.seed:
                yield S._long(int(seed), (side, side), f=N.field(name, (side, side), int(seed)))

    return X.seeds(spark, d).mapInPandas(run, "sid bigint, r bigint, c bigint, f double")


def _summary(df):
    return df.groupBy("sid").agg(F.count(F.lit(1)).alias("cells"), F.round(F.min("f"), 6).alias("low"), F.round(F.max("f"), 6).alias("high"), F.round(F.avg("f"), 6).alias("mean"))


@query("Y-02_gaussian_field")
def gaussian(spark, d):
    return _summary(fields(spark, d, "grf"))


@query("Y-03_midpoint_field")
def midpoint(spark, d):
    return _summary(fields(spark, d, "fractal"))


@query("Y-04_random_cluster")
def cluster(spark, d):
    return _summary(fields(spark, d, "random_cluster"))


_SEEDS = [(3, 4), (20, 9), (11, 27), (29, 30)]
_SEED_SQL = "p(k, pr, pc) AS (VALUES " + ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(_SEEDS)) + ")"


def _nearest_seed():
    """Squared distance to, and number of, the nearest seed (ties to the first)."""
    each = [F.struct(((F.col("r") - r) * (F.col("r") - r) + (F.col("c") - c) * (F.col("c") - c)).alias("d2"), F.lit(i).alias("k")) for i, (r, c) in enumerate(_SEEDS)]
    return F.least(*each)


@query("Y-07_distance_gradient", f"WITH {X.CELLS}, {_SEED_SQL}, m AS (SELECT sid, r, c, sqrt(min((r - pr) * (r - pr) + (c - pc) * (c - pc))) AS d FROM cells, p GROUP BY ALL) SELECT sid, r, c, round((d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w), 6) AS f FROM m WINDOW w AS (PARTITION BY sid)")
def distance_gradient(spark, d):
    g = X.cells(spark, d).select("sid", "r", "c", F.sqrt(_nearest_seed()["d2"].cast("double")).alias("d"))
    return C.rescale(g, "d", "f").select("sid", "r", "c", F.round("f", 6).alias("f"))


@query("Y-08_mosaic", f"WITH {X.CELLS}, {_SEED_SQL} SELECT sid, r, c, CAST(arg_min(k, ((r - pr) * (r - pr) + (c - pc) * (c - pc)) * 10 + k) AS INTEGER) AS element FROM cells, p GROUP BY sid, r, c")
def mosaic(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", _nearest_seed()["k"].cast("int").alias("element"))


@query("Y-10_patch_mosaic", f"WITH {X.GRIDS}, q AS (SELECT sid, quantile_cont(v, [0.25, 0.5, 0.75]) AS e FROM grids GROUP BY sid) SELECT sid, r, c, ([0.0, 0.35, 1.0, 0.6])[len(list_filter(e, lambda x: x <= v)) + 1]::DOUBLE AS f FROM grids JOIN q USING (sid)")
def patch_mosaic(spark, d):
    values = F.array(*[F.lit(x) for x in (0.0, 0.35, 1.0, 0.6)])
    return C.digitize(X.grids(spark, d), "v", 4).select("sid", "r", "c", F.get(values, F.col("cls")).alias("f"))


@query("Y-11_nodata_blobs")
def blobs(spark, d):
    """Cells of a Gaussian field under its 20 % quantile are no data; of the rest the largest component stays."""
    from ..operators.graph import component_labels

    f = fields(spark, d, "grf")
    edge = C.quantile_edges(f, "f", [0.2])
    valid = f.join(edge, "sid").where(F.col("f") >= F.get("edges", F.lit(0))).select("sid", "r", "c")
    return component_labels(valid).where("label = 0").groupBy("sid").agg(F.count(F.lit(1)).alias("n_valid"))


@query("Y-12_dispatch")
def dispatch(spark, d):
    """Every generator by name, with its default parameters."""
    parts = [_summary(fields(spark, d, n)).withColumn("generator", F.lit(n)) for n in sorted(N.FIELDS)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("Y-14_regenerate", f"WITH {X.SEEDS} SELECT seed AS sid, true AS same, CAST(1024 AS BIGINT) AS cells FROM seeds")
def regenerate(spark, d):
    """Landscapes made again from their stored parameters agree with those drawn in every cell."""
    seeds = X.seeds(spark, d)
    # A few bytes of seeds would be one task, and what grows from them would pass for small enough to broadcast.
    seeds = seeds.repartition(4 * spark.sparkContext.defaultParallelism, "seed")
    a, b = S.landscapes(seeds), S.regenerated(S.parameters(seeds)).withColumnsRenamed({"resistance": "r2", "valid": "v2"})
    both = a.join(b.hint("merge"), ["sid", "r", "c"])
    return both.groupBy("sid").agg(F.bool_and((F.col("resistance") == F.col("r2")) & (F.col("valid") == F.col("v2"))).alias("same"), F.count(F.lit(1)).alias("cells"))


@query("Y-01_sub_seeds", f"WITH {X.SEEDS} SELECT seed, name, CAST('0x' || substr(sha256(seed || '|' || name), 1, 8) AS BIGINT) AS sub_seed FROM seeds, (VALUES ('base'), ('barriers'), ('nodata'), ('patches')) t(name)")
def sub_seeds(spark, d):
    """Seeds of independent streams by name, in place of a guarded global generator."""
    names = F.explode(F.array(*[F.lit(n) for n in ("base", "barriers", "nodata", "patches")])).alias("name")
    s = X.seeds(spark, d).select("seed", names)
    return s.select("seed", "name", F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("seed").cast("string"), "name"), 256), 1, 8), 16, 10).cast("bigint").alias("sub_seed"))


# -- sources ------------------------------------------------------------------------


@query("G-06_patch_labels", f"WITH RECURSIVE {_COMP} SELECT sid, r, c, label FROM comp WHERE size >= 3")
def patch_labels(spark, d):
    return labelled(spark, d).where("size >= 3").select("sid", "r", "c", "label")


@query("G-07_distance_transform", f"WITH {X.GRIDS}, f AS (SELECT sid, r, c FROM grids WHERE v > 0.15), m AS (SELECT g.sid, g.r, g.c, min((g.r - f.r) * (g.r - f.r) + (g.c - f.c) * (g.c - f.c)) AS d2 FROM grids g JOIN f USING (sid) GROUP BY ALL) SELECT g.sid, g.r, g.c, round(coalesce(sqrt(d2), 80.0), 6) AS distance FROM grids g LEFT JOIN m ON g.sid = m.sid AND g.r = m.r AND g.c = m.c")
def distance_transform(spark, d):
    g = X.grids(spark, d).select("sid", "r", "c", "v")
    hits = g.where("v > 0.15").withColumn("one", F.lit(1))
    return C.nearest_feature(g.select("sid", "r", "c"), hits, "one", 1.0, 8).select("sid", "r", "c", F.round("distance", 6).alias("distance"))


def chosen_regions(patches, k: int, separation: int, seed: int = 1):
    """Greedy choice of patches per raster in hash order, centroids apart by ``separation``; fewer than two: none."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "sid", "label"), 256)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got: list = []
        for p in pdf.sort_values("key").itertuples():
            if len(got) < k and all(max(abs(p.row - q.row), abs(p.col - q.col)) >= separation for q in got):
                got.append(p)
        got = got if len(got) >= 2 else []
        return pd.DataFrame([(p.sid, i + 1, p.label, p.row, p.col, p.n) for i, p in enumerate(got)], columns=["sid", "region", "label", "row", "col", "n"])

    return patches.withColumn("key", order).groupBy("sid").applyInPandas(run, "sid bigint, region int, label int, row bigint, col bigint, n bigint")


@query("C-03_regions")
def regions(spark, d):
    from .network import patches

    return chosen_regions(patches(spark, d), 4, 2)


def source_configs(spark, d):
    """All configurations of the small rasters as records: points, strips both ways, advanced, omniscape."""
    g = small(spark, d)
    strip = lambda c, n: g.where(f"{c} < 1 OR {c} >= 7").groupBy("sid").agg(F.lit(n).alias("config"), F.lit("wall_to_wall").alias("kind"), F.count(F.lit(1)).alias("n_pixels"))
    points = focal_cells(spark, d).where("focal > 0").groupBy("sid").agg(F.lit("points").alias("config"), F.lit("points").alias("kind"), F.count(F.lit(1)).alias("n_pixels"))
    edge = g.groupBy("sid").agg(F.percentile("res", F.lit(0.25)).alias("q"))
    strong = g.join(edge, "sid").where("res <= q")
    adv = strong.where("r > 0").groupBy("sid").agg(F.lit("advanced").alias("config"), F.lit("advanced").alias("kind"), F.count(F.lit(1)).alias("n_pixels"))
    omni = strong.groupBy("sid").agg(F.lit("omniscape").alias("config"), F.lit("omniscape").alias("kind"), F.count(F.lit(1)).alias("n_pixels"))
    return reduce(lambda a, b: a.unionByName(b), [points, strip("r", "wall_to_wall_NS"), strip("c", "wall_to_wall_EW"), adv, omni])


_CFG = f"""{SMALL}, g AS (SELECT * FROM rs), e AS (SELECT sid, quantile_cont(res, 0.25) AS q FROM g GROUP BY sid), st AS (SELECT g.* FROM g JOIN e USING (sid) WHERE res <= q),
cfg AS (SELECT sid, 'points' AS config, 'points' AS kind, count(*) AS n_pixels FROM g WHERE (r = 0 AND c = 0) OR (r = 7 AND c = 7) OR (r = 0 AND c = 7) GROUP BY sid
  UNION ALL SELECT sid, 'wall_to_wall_NS', 'wall_to_wall', count(*) FROM g WHERE r < 1 OR r >= 7 GROUP BY sid UNION ALL SELECT sid, 'wall_to_wall_EW', 'wall_to_wall', count(*) FROM g WHERE c < 1 OR c >= 7 GROUP BY sid
  UNION ALL SELECT sid, 'advanced', 'advanced', count(*) FROM st WHERE r > 0 GROUP BY sid UNION ALL SELECT sid, 'omniscape', 'omniscape', count(*) FROM st GROUP BY sid)"""


@query("C-07_all_configurations", f"WITH {_CFG} SELECT * FROM cfg")
def all_configurations(spark, d):
    return source_configs(spark, d)


@query("C-08_records", f"WITH {_CFG} SELECT sid, kind, count(*) AS configs, CAST(sum(n_pixels) AS BIGINT) AS n_pixels FROM cfg GROUP BY sid, kind")
def records(spark, d):
    return source_configs(spark, d).groupBy("sid", "kind").agg(F.count(F.lit(1)).alias("configs"), F.sum("n_pixels").alias("n_pixels"))


# -- solver variants ----------------------------------------------------------------


@query("G-14_refinement", f"WITH {X.GRIDS} SELECT DISTINCT sid, true AS improved, true AS exact FROM grids")
def refinement(spark, d):
    """One refinement step: the residual's own solution is added; the residual must not grow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        res, valid, focal = S._grid(pdf, "resistance", "valid", "focal")
        cond, ground, top = N.conductances(res, valid), focal == 1, focal == 2
        v = N.solve(cond, valid, top[None].astype(float), ground)[0].astype(np.float32).astype(float)
        v = np.where(ground, 0.0, v)
        before = N.residual(cond, valid, v, top.astype(float), ground)
        rest = np.where(valid, top - N.apply_laplacian(cond, v), 0.0)
        better = v + N.solve(cond, valid, rest[None], ground)[0]
        after = N.residual(cond, valid, better, top.astype(float), ground)
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "improved": [after <= before], "exact": [after < 1e-12]})

    return focal_cells(spark, d).groupBy("sid").applyInPandas(run, "sid bigint, improved boolean, exact boolean")


@query("G-15_fallback_agrees", f"WITH {X.GRIDS} SELECT DISTINCT sid, true AS agree FROM grids")
def fallback(spark, d):
    """Direct and iterative effective resistances of the same rasters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = S._grid(pdf, "resistance", "valid", "focal")
        a, b = N.pairwise(*g)["reff"], S._iterative(*g)["reff"]
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "agree": [bool(np.allclose(a, b, rtol=1e-7))]})

    return focal_cells(spark, d).groupBy("sid").applyInPandas(run, "sid bigint, agree boolean")


# -- plans, loaders, validation -------------------------------------------------------


@query("M-02_plan_real", f"WITH {X.TILES}, {quota_sql()} SELECT tile_id, table_id, row_number() OVER (PARTITION BY table_id ORDER BY tile_id) + 1000 AS seed FROM quota")
def plan_real(spark, d):
    t = quota(spark, d)
    return t.withColumn("seed", F.row_number().over(Window.partitionBy("table_id").orderBy("tile_id")) + 1000).select("tile_id", "table_id", F.col("seed").cast("bigint").alias("seed"))


@query("M-05_contrast_override", f"WITH {X.GRIDS}, f AS (SELECT sid, r, c, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS f FROM grids WINDOW w AS (PARTITION BY sid)) SELECT sid, r, c, round(pow(CASE WHEN sid % 2 = 0 THEN 100.0 ELSE 10.0 END, f), 5) AS resistance FROM f")
def contrast_override(spark, d):
    f = C.rescale(X.grids(spark, d), "v", "f")
    r = F.when(F.col("sid") % 2 == 0, C.field_to_resistance(F.col("f"), 100.0)).otherwise(C.field_to_resistance(F.col("f"), 10.0))
    return f.select("sid", "r", "c", F.round(r, 5).alias("resistance"))


@query("M-12_extraction", f"""WITH {X.CELLS}, {SURFACE}, q AS (SELECT sid, avg(CAST(landcover IN (0, 70, 80) AS DOUBLE)) AS bad, count(elevation) AS n_elevation, CAST(max(road_class) AS BIGINT) AS top_road FROM cells GROUP BY sid) SELECT sid, round(bad, 6) AS frac_unusable, n_elevation, top_road, bad <= 0.9 AS accept FROM q""")
def extraction(spark, d):
    bad = F.avg(F.col("landcover").isin(0, 70, 80).cast("double"))
    return X.cells(spark, d).groupBy("sid").agg(F.round(bad, 6).alias("frac_unusable"), F.count("elevation").alias("n_elevation"), F.max("road_class").alias("top_road"), (bad <= 0.9).alias("accept"))


@query("M-09_parallel_extraction", f"WITH {X.CELLS} SELECT sid, count(*) AS pixels, count(elevation) AS n_elevation, round(avg(CAST(landcover IN (0, 70, 80) AS DOUBLE)), 6) AS frac_unusable FROM cells GROUP BY sid")
def parallel_extraction(spark, d):
    """One task a raster, as many at once as there are cores: the tile's counts by array code."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = np.isin(pdf.landcover.to_numpy(), [0, 70, 80])
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "pixels": [len(pdf)], "n_elevation": [int(pdf.elevation.notna().sum())], "frac_unusable": [round(float(bad.mean()), 6)]})

    return X.cells(spark, d).select("sid", "landcover", "elevation").groupBy("sid").applyInPandas(run, "sid bigint, pixels bigint, n_elevation bigint, frac_unusable double")


@query("V-02_metadata", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 AS ok FROM events")
def metadata(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return X.runs(spark, d).select("event_id", F.coalesce(k >= 0, F.lit(False)).alias("ok"))


@query("V-05_resistance_matrix", """WITH p AS (SELECT vec_id AS sid, i, j, 0.6::DOUBLE + abs(CAST(embedding[i * 8 + j + 1] AS DOUBLE)) AS reff FROM embeddings, range(8) a(i), range(8) b(j) WHERE i < j),
b AS (SELECT * FROM p UNION ALL SELECT sid, j, i, reff FROM p), t AS (SELECT a.sid, count(*) AS broken FROM b a JOIN b c ON a.sid = c.sid AND a.j = c.i JOIN p x ON x.sid = a.sid AND x.i = a.i AND x.j = c.j WHERE x.reff > a.reff + c.reff + 1e-9 GROUP BY a.sid)
SELECT sid, count(*) = 28 AS complete, bool_and(reff > 0 AND isfinite(reff)) AS positive, coalesce(max(broken), 0) AS broken FROM p LEFT JOIN t USING (sid) GROUP BY sid""")
def matrix_checks(spark, d):
    """Matrices of eight labels: all pairs there, positive and finite, and where a detour would be shorter than the pair."""
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.posexplode("embedding").alias("pos", "v"))
    p = e.select("sid", F.expr("pos DIV 8").alias("i"), (F.col("pos") % 8).alias("j"), (0.6 + F.abs(F.col("v").cast("double"))).alias("reff")).where("i < j")
    return V.matrices(p, 8)


@query("V-05b_solved_matrices", f"WITH {X.GRIDS} SELECT DISTINCT sid, true AS complete, true AS positive, CAST(0 AS BIGINT) AS broken FROM grids")
def solved_matrices(spark, d):
    """Effective resistances of the small rasters are metrics."""
    return V.matrices(S.pairwise(focal_cells(spark, d)).select("sid", "i", "j", "reff"), 3)


# -- shard states -------------------------------------------------------------------


@query("SNK-01_tile_digest", f"WITH {X.CELLS} SELECT sid, sha256(string_agg(coalesce(CAST(elevation AS VARCHAR), '-9999') || ',' || CAST(landcover AS VARCHAR), ';' ORDER BY r, c)) AS digest FROM cells GROUP BY sid")
def tile_digest(spark, d):
    cell = F.concat_ws(",", F.coalesce(F.col("elevation").cast("string"), F.lit("-9999")), F.col("landcover").cast("string"))
    g = X.cells(spark, d).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("r", "c", cell.alias("x")))).alias("a"))
    return g.select("sid", F.sha2(F.array_join(F.col("a.x"), ";"), 256).alias("digest"))


@query("SNK-02_surface_summary", f"WITH {X.CELLS}, {SURFACE} SELECT table_id, count(*) AS cells, count(*) FILTER (nodata) AS nodata, round(avg(CAST(resistance AS DOUBLE)) FILTER (NOT nodata), 4) AS mean FROM surface GROUP BY table_id")
def surface_summary(spark, d):
    return surface(spark, d).groupBy("table_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("nodata").alias("nodata"), F.round(F.avg(F.when(~F.col("nodata"), F.col("resistance").cast("double"))), 4).alias("mean"))


@query("SNK-12_shard_states", """WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS a, count(*) FILTER (event_id % 5 = 0) AS failed FROM events GROUP BY user_id) SELECT user_id, CASE WHEN failed > 3 THEN 'failed' WHEN failed > 0 THEN 'retry' ELSE 'ok' END AS state, least(failed, 3) AS tries FROM s""")
def shard_states(spark, d):
    """A shard's state from its log: verified at once, to be tried again, or given up after three failures."""
    s = X.runs(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_id") % 5 == 0).alias("failed"))
    state = F.when(F.col("failed") > 3, "failed").when(F.col("failed") > 0, "retry").otherwise("ok")
    return s.select("user_id", state.alias("state"), F.least("failed", F.lit(3)).alias("tries"))
