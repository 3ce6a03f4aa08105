"""Queries on solvers, generators and geometry; those without SQL return rows only, and tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import polygons as G
from ..operators import resistance as R
from ..operators import solve as S
from ..sources import fixtures as X
from .network import small
from .registry import query


def focal_cells(spark, d):
    """Small rasters, all valid, with focal points in three corners."""
    focal = F.when((F.col("r") == 0) & (F.col("c") == 0), 1).when((F.col("r") == 7) & (F.col("c") == 7), 2).when((F.col("r") == 0) & (F.col("c") == 7), 3).otherwise(0)
    return small(spark, d).select("sid", "r", "c", F.col("res").alias("resistance"), F.lit(True).alias("valid"), focal.alias("focal"))


@query("G-10_pairwise_solve")
def pairwise(spark, d):
    return S.pairwise(focal_cells(spark, d)).select("sid", "i", "j", F.round("reff", 6).alias("reff"), (F.col("residual") < 1e-9).alias("exact"), "fallback_used")


@query("G-10b_pair_maps")
def pair_maps(spark, d):
    return S.pair_maps(focal_cells(spark, d)).select("sid", "i", "j", "r", "c", F.round("voltage", 6).alias("voltage"), F.round("current", 6).alias("current"))


@query("G-10c_cumulative_current")
def cumulative(spark, d):
    return S.cumulative(focal_cells(spark, d)).select("sid", "r", "c", F.round("cum_current", 6).alias("cum_current"))


@query("G-11_advanced_solve")
def advanced(spark, d):
    cells = focal_cells(spark, d).withColumn("source", (F.col("r") == 7).cast("double") / 8).withColumn("ground", F.col("r") == 0)
    return S.advanced(cells).select("sid", "r", "c", F.round("voltage", 6).alias("voltage"), F.round("current", 6).alias("current"), (F.col("residual") < 1e-9).alias("exact"))


@query("G-12_moving_window")
def moving_window(spark, d):
    cells = focal_cells(spark, d).withColumn("source", 1.0 / F.col("resistance"))
    return S.moving_window(cells, 3).select("sid", "r", "c", *[F.round(x, 6).alias(x) for x in ("cum_current", "flow_potential", "normalized")])


@query("G-13_gradient_iterations")
def convergence(spark, d):
    return S.convergence(focal_cells(spark, d))


@query("Y-13_synthetic_landscapes")
def landscapes(spark, d):
    """One landscape for each seed, drawn from the prior."""
    return S.landscapes(X.seeds(spark, d)).groupBy("sid", "generator", "contrast").agg(F.count_if("valid").alias("n_valid"), F.round(F.max("resistance"), 4).alias("r_max"), F.round(F.min("resistance"), 4).alias("r_min"))


@query("C-01_focal_points")
def points(spark, d):
    return S.focal_points(S.landscapes(X.seeds(spark, d)))


@query("C-09_random_table")
def random_table(spark, d):
    t = S.perturbed_table(K.TABLES["large_mammal"], 20260905)
    return R.statistics(R.apply_tables(X.cells(spark, d), {"random_lm": t})).select("sid", "table_id", F.round("r_median", 6).alias("r_median"), F.round("r_max_obs", 6).alias("r_max_obs"))


@query("A-26_region_outlines")
def outlines(spark, d):
    from .network import labelled

    return S.outlines(labelled(spark, d).where("size >= 4").select("sid", "label", "r", "c"))


def quota_sql() -> str:
    """The tables' turns as a chain: each takes its quota of what the ones before left."""
    parts, taken = ["q AS (SELECT count(*) // 10 AS n FROM tiles)"], []
    for k, name in enumerate(K.TABLE_NAMES):
        left = " AND ".join(f"tile_id NOT IN (SELECT tile_id FROM w{j})" for j in range(k)) or "true"
        parts.append(f"w{k} AS (SELECT tile_id, '{name}' AS table_id FROM tiles WHERE {left} ORDER BY sha256('{name}|' || tile_id), tile_id LIMIT (SELECT n FROM q))")
        taken.append(f"SELECT * FROM w{k}")
    return ", ".join(parts) + f", quota AS ({' UNION ALL '.join(taken)})"


@query("W-08_table_quota", f"WITH {X.TILES}, {quota_sql()} SELECT * FROM quota")
def quota(spark, d, share: int = 10):
    """Each table in turn takes one of ``share`` parts of the tiles, in hash order; every tile is used once."""
    tiles = X.tiles(spark, d).select("tile_id")
    n, out = tiles.count() // share, None
    for name in K.TABLE_NAMES:
        left = tiles if out is None else tiles.join(out.select("tile_id"), "tile_id", "left_anti")
        took = left.orderBy(F.sha2(F.concat_ws("|", F.lit(name), "tile_id"), 256), "tile_id").limit(n).withColumn("table_id", F.lit(name))
        out = took if out is None else out.unionByName(took)
    return out


_POLY = """pt AS (SELECT n_nationkey AS k, [(-180.0 + 14 * k, -50.0 + k), (-150.0 + 14 * k, -55.0), (-140.0 + 14 * k, 40.0), (-160.0 + 14 * k, 68.0 - k)] AS p FROM (SELECT CAST(n_nationkey AS DOUBLE) AS k, n_nationkey FROM nation)),
poly AS (SELECT 'P' || lpad(CAST(k AS VARCHAR), 2, '0') AS poly, p[i][1]::DOUBLE AS x0, p[i][2]::DOUBLE AS y0, p[i % 4 + 1][1]::DOUBLE AS x1, p[i % 4 + 1][2]::DOUBLE AS y1 FROM pt, range(1, 5) t(i))"""


def polygons(spark, d):
    """One quadrilateral for each nation, as edges."""
    k = F.col("n_nationkey").cast("double")
    corners = [(-180.0 + 14 * k, -50.0 + k), (-150.0 + 14 * k, F.lit(-55.0)), (-140.0 + 14 * k, F.lit(40.0)), (-160.0 + 14 * k, 68.0 - k)]
    edges = [F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    return X.table(spark, d, "nation").select(F.concat(F.lit("P"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("poly"), F.inline(F.array(*edges)))


def inside_sql(points: str) -> str:
    return f"hit AS (SELECT id, poly, count(*) AS n FROM {points} JOIN poly ON (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY id, poly), inn AS (SELECT id, min(poly) AS poly FROM hit WHERE n % 2 = 1 GROUP BY id)"


@query("J-11_point_in_polygon", f"WITH {X.TILES}, {_POLY}, p AS (SELECT tile_id AS id, lon AS x, lat AS y FROM tiles), {inside_sql('p')} SELECT id AS tile_id, poly FROM inn")
def point_in_polygon(spark, d):
    p = X.tiles(spark, d).select(F.col("tile_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return G.within(p, polygons(spark, d)).withColumnRenamed("id", "tile_id")


@query("G-08_line_rasterisation", f"""WITH {X.TILES}, p AS (SELECT c_custkey, lon + 180 AS x, lat + 55 AS y FROM tiles), s AS (SELECT c_custkey AS line, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY c_custkey // 10 ORDER BY c_custkey)),
t AS (SELECT *, list_sort(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_concat([(k * 10.0::DOUBLE - x) / (x1 - x) FOR k IN range(CAST(floor(least(x, x1) / 10) AS BIGINT) + 1, CAST(ceil(greatest(x, x1) / 10) AS BIGINT))], [(k * 10.0::DOUBLE - y) / (y1 - y) FOR k IN range(CAST(floor(least(y, y1) / 10) AS BIGINT) + 1, CAST(ceil(greatest(y, y1) / 10) AS BIGINT))]))) AS a FROM s WHERE x1 IS NOT NULL),
m AS (SELECT line, x, y, x1, y1, unnest([(a[i] + a[i + 1]) / 2 FOR i IN range(1, len(a))]) AS z FROM t)
SELECT CAST(floor((y + z * (y1 - y)) / 10.0::DOUBLE) AS BIGINT) AS r, CAST(floor((x + z * (x1 - x)) / 10.0::DOUBLE) AS BIGINT) AS c, max(line) AS line FROM m GROUP BY ALL""")
def lines(spark, d):
    """Cells touched by lines between consecutive tiles' places, later lines over earlier ones."""
    t = X.tiles(spark, d).select("c_custkey", (F.col("lon") + 180).alias("x"), (F.col("lat") + 55).alias("y"))
    w = Window.partitionBy(F.floor(F.col("c_custkey") / 10)).orderBy("c_custkey")
    s = t.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 IS NOT NULL").withColumnRenamed("c_custkey", "line")
    return G.crossed_cells(s, 10.0).groupBy("r", "c").agg(F.max("line").alias("line"))


@query("G-09_bilinear_resample", f"""WITH {X.GRIDS}, t AS (SELECT sid, tr, tc, (tr + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS y, (tc + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS x FROM (SELECT DISTINCT sid FROM grids), range(5) a(tr), range(5) b(tc)),
w AS (SELECT sid, tr, tc, least(greatest(CAST(floor(y) AS BIGINT) + i, 0), 7) AS r, least(greatest(CAST(floor(x) AS BIGINT) + j, 0), 7) AS c, (CASE WHEN i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM t, range(2) a(i), range(2) b(j))
SELECT sid, CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, round(sum(w * v) / sum(w), 6) AS v FROM w JOIN grids USING (sid, r, c) GROUP BY ALL""")
def resample(spark, d):
    """The small rasters on five by five cells of the same extent, bilinear."""
    return G.resampled(X.grids(spark, d), "v", 8, 5).select("sid", "tr", "tc", F.round("v", 6).alias("v"))


@query("G-09b_nearest_resample", f"WITH {X.GRIDS} SELECT sid, CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, round(v, 6) AS v FROM grids JOIN (SELECT tr, CAST(floor((tr + 0.5) * 1.6) AS BIGINT) AS r FROM range(5) t(tr)) USING (r) JOIN (SELECT tc, CAST(floor((tc + 0.5) * 1.6) AS BIGINT) AS c FROM range(5) t(tc)) USING (c)")
def resample_nearest(spark, d):
    return G.resampled(X.grids(spark, d), "v", 8, 5, nearest=True).select("sid", "tr", "tc", F.round("v", 6).alias("v"))


_SPHERE = """u AS (SELECT c_custkey AS id, CAST('0x' || substr(sha256('u|' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST('0x' || substr(sha256('v|' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS v FROM customer),
p AS (SELECT id, v * 360 - 180 AS x, degrees(asin(u * (sin(radians(72.0::DOUBLE)) - sin(radians(-60.0::DOUBLE))) + sin(radians(-60.0::DOUBLE)))) AS y FROM u)"""


@query("M-13_sphere_points", f"WITH {_POLY}, {_SPHERE}, {inside_sql('p')} SELECT id, round(y, 6) AS lat, round(x, 6) AS lon, poly FROM p JOIN inn USING (id)")
def sphere(spark, d):
    """Points uniform on the sphere between two latitudes, from hashes; those that no polygon of land holds go."""
    from ..functions.geo import hash_share

    lo, hi = F.sin(F.radians(F.lit(-60.0))), F.sin(F.radians(F.lit(72.0)))
    u, v = (hash_share(F.lit(n), F.col("id").cast("string")) for n in "uv")
    p = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).select("id", (v * 360 - 180).alias("x"), F.degrees(F.asin(u * (hi - lo) + lo)).alias("y"))
    return p.join(G.within(p, polygons(spark, d)), "id").select("id", F.round("y", 6).alias("lat"), F.round("x", 6).alias("lon"), "poly")
