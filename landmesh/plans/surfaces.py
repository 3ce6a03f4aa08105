"""Queries on resistance surfaces and raster cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import cells as C
from ..operators import resistance as R
from ..sources import fixtures as X
from .registry import query


def _clip(c: str, lo, hi) -> str:
    return f"least(greatest(coalesce(CAST({c} AS DOUBLE), 0), {lo}), {hi})"


def surface_sql(tables: dict[str, dict] = K.TABLES) -> str:
    """The tables applied to all cells, as one SQL text."""
    parts = []
    for name, t in tables.items():
        if t["base"] == "landcover":
            base = X.case("landcover", {k: float(v) for k, v in t["landcover"].items()}, str(t["r_max"]))
        elif t["base"] == "ghm":
            base = f"1 + {t['a']} * ({_clip('ghm', 0, 1)} * {_clip('ghm', 0, 1)})"
        else:
            base = str(float(t["constant"]))
        r = f"CAST({base} AS DOUBLE)"
        if "slope" in t:
            r += f" * (1 + {t['slope'][0]}::DOUBLE * {_clip('slope', 0, t['slope'][1])})"
        if "bands" in t:
            e = "coalesce(CAST(elevation AS DOUBLE), 0)"
            r += " * CASE " + " ".join(f"WHEN {e} <= {b} THEN {f}::DOUBLE" for b, f in t["bands"]) + f" ELSE {t['bands'][-1][1]}::DOUBLE END"
        if "roads" in t:
            r += f" + CASE WHEN road_distance <= {t['buffer_m']} AND road_class > 0 THEN {X.case('road_class', {k: float(v) for k, v in t['roads'].items()}, '0')} ELSE 0 END::DOUBLE"
        if "ghm_additive" in t:
            r += f" + {t['ghm_additive']}::DOUBLE * {_clip('ghm', 0, 1)}"
        if t["water"][0] == "barrier":
            r = f"CASE WHEN landcover = 80 THEN {t['water'][1]} ELSE {r} END"
        nodata = "landcover = 0" + (" OR landcover = 80" if t["water"][0] == "nodata" else "")
        parts.append(f"SELECT sid, r, c, '{name}' AS table_id, {t['r_max']}::DOUBLE AS r_max, ({nodata}) AS nodata, CAST(CASE WHEN {nodata} THEN 1.0 ELSE least(greatest({r}, 1.0), {t['r_max']}) END AS FLOAT) AS resistance FROM cells")
    return "surface AS (" + " UNION ALL ".join(parts) + ")"


SURFACE = surface_sql()


def surface(spark, d):
    return R.apply_tables(X.cells(spark, d))


@query("A-01_resistance_statistics", f"""WITH {X.CELLS}, {SURFACE}, v AS (SELECT *, CASE WHEN NOT nodata THEN CAST(resistance AS DOUBLE) END AS x FROM surface)
SELECT sid, table_id, round(min(x), 6) AS r_min, round(max(x), 6) AS r_max_obs, round(quantile_cont(x, 0.5), 6) AS r_median, round(avg(CAST(nodata AS DOUBLE)), 6) AS frac_nodata,
  round(avg(CASE WHEN NOT nodata THEN CAST(resistance >= r_max AS DOUBLE) END), 6) AS frac_at_rmax, round(log10(max(x) / min(x)), 6) AS log10_contrast FROM v GROUP BY sid, table_id""")
def statistics(spark, d):
    s = R.statistics(surface(spark, d))
    return s.select("sid", "table_id", *[F.round(c, 6).alias(c) for c in ("r_min", "r_max_obs", "r_median", "frac_nodata", "frac_at_rmax", "log10_contrast")])


@query("P-20_resistance_cells", f"WITH {X.CELLS}, {SURFACE} SELECT sid, r, c, table_id, nodata, round(CAST(resistance AS DOUBLE), 3) AS resistance FROM surface")
def resistance_cells(spark, d):
    return surface(spark, d).select("sid", "r", "c", "table_id", "nodata", F.round(F.col("resistance").cast("double"), 3).alias("resistance"))


@query("P-14_class_lookup", f"WITH {X.CELLS} SELECT sid, r, c, CAST({X.case('landcover', {k: float(v) for k, v in K.TABLES['amphibian']['landcover'].items()}, '1000.0')} AS DOUBLE) AS value FROM cells")
def class_lookup(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", R.lookup(K.TABLES["amphibian"]["landcover"], F.col("landcover"), 1000.0).alias("value"))


@query("P-15_base_terms", f"WITH {X.CELLS} SELECT sid, r, c, round(1 + 999.0 * ({_clip('ghm', 0, 1)} * {_clip('ghm', 0, 1)}), 6) AS from_ghm, 5.0::DOUBLE AS from_constant FROM cells")
def base_terms(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", F.round(R.base_term(K.TABLES["generic_hm"]), 6).alias("from_ghm"), R.base_term(K.TABLES["constant"]).alias("from_constant"))


@query("P-16_slope_factor", f"WITH {X.CELLS} SELECT sid, r, c, round(1 + 0.06::DOUBLE * {_clip('slope', 0, 45)}, 6) AS factor FROM cells")
def slope_factor(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", F.round(R.slope_factor(K.TABLES["amphibian"]), 6).alias("factor"))


_BAND = "CASE WHEN coalesce(elevation, 0) <= 1500 THEN 1.0 WHEN coalesce(elevation, 0) <= 3000 THEN 2.0 ELSE 4.0 END"


@query("P-17_elevation_bands", f"WITH {X.CELLS} SELECT sid, r, c, CAST({_BAND} AS DOUBLE) AS factor FROM cells")
def bands(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", R.band_factor(K.TABLES["forest_bird"]).alias("factor"))


@query("J-12_band_range_join", f"""WITH {X.CELLS}, b(lo, hi, factor) AS (VALUES (-1e9, 1500.0, 1.0), (1500.0, 3000.0, 2.0), (3000.0, 9000.0, 4.0))
SELECT sid, r, c, CAST(factor AS DOUBLE) AS factor FROM cells JOIN b ON coalesce(elevation, 0) > lo AND coalesce(elevation, 0) <= hi""")
def band_join(spark, d):
    bands = spark.createDataFrame([(-1e9, 1500.0, 1.0), (1500.0, 3000.0, 2.0), (3000.0, 9000.0, 4.0)], "lo double, hi double, factor double")
    e = F.coalesce(F.col("elevation"), F.lit(0))
    return X.cells(spark, d).join(F.broadcast(bands), (e > F.col("lo")) & (e <= F.col("hi"))).select("sid", "r", "c", "factor")


@query("P-18_road_penalty", f"WITH {X.CELLS} SELECT sid, r, c, CAST(CASE WHEN road_distance <= 60 AND road_class > 0 THEN {X.case('road_class', K.TABLES['large_mammal']['roads'], '0')} ELSE 0 END AS DOUBLE) AS penalty FROM cells")
def road_penalty(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", R.road_penalty(K.TABLES["large_mammal"]).alias("penalty"))


@query("P-19_additive_modification", f"WITH {X.CELLS} SELECT sid, r, c, round(100.0::DOUBLE * {_clip('ghm', 0, 1)}, 6) AS added FROM cells")
def additive(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", F.round(R.modification(K.TABLES["large_mammal"]), 6).alias("added"))


@query("F-03_valid_cells", f"WITH {X.CELLS} SELECT sid, count(*) AS n FROM cells WHERE landcover <> 0 GROUP BY sid")
def valid_cells(spark, d):
    return X.cells(spark, d).where("landcover <> 0").groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("F-04_habitat_cells", f"WITH {X.CELLS} SELECT sid, r, c, landcover FROM cells WHERE landcover IN (10, 20, 90, 95)")
def habitat(spark, d):
    return X.cells(spark, d).where(F.col("landcover").isin(10, 20, 90, 95)).select("sid", "r", "c", "landcover")


@query("F-09_on_road", f"WITH {X.CELLS} SELECT sid, r, c, coalesce(road_distance <= 60 AND road_class > 0, false) AS on_road FROM cells")
def on_road(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", F.coalesce((F.col("road_distance") <= 60) & (F.col("road_class") > 0), F.lit(False)).alias("on_road"))


_QC = """frac_lc_nodata + frac_water + frac_snow AS frac_unusable"""


@query("A-02_tile_quality", f"""WITH {X.CELLS}, a AS (SELECT sid, avg(CAST(landcover = 0 AS DOUBLE)) AS n, avg(CAST(landcover = 80 AS DOUBLE)) AS w, avg(CAST(landcover = 70 AS DOUBLE)) AS s, avg(CAST(elevation IS NULL AS DOUBLE)) AS e, count(*) AS n_pixels, count(DISTINCT road_class) AS road_classes FROM cells GROUP BY sid)
SELECT sid, round(n, 6) AS frac_lc_nodata, round(w, 6) AS frac_water, round(s, 6) AS frac_snow_ice, round(e, 6) AS frac_dem_nan, round(n + w + s, 6) AS frac_unusable, n_pixels, road_classes, (n + w + s <= 0.9 AND e <= 0.10) AS accept FROM a""")
def tile_quality(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    a = X.cells(spark, d).groupBy("sid").agg(share(F.col("landcover") == K.NODATA_CLASS).alias("n"), share(F.col("landcover") == K.WATER_CLASS).alias("w"), share(F.col("landcover") == K.SNOW_CLASS).alias("s"), share(F.col("elevation").isNull()).alias("e"), F.count(F.lit(1)).alias("n_pixels"), F.countDistinct("road_class").alias("road_classes"))
    bad = F.col("n") + F.col("w") + F.col("s")
    return a.select("sid", F.round("n", 6).alias("frac_lc_nodata"), F.round("w", 6).alias("frac_water"), F.round("s", 6).alias("frac_snow_ice"), F.round("e", 6).alias("frac_dem_nan"), F.round(bad, 6).alias("frac_unusable"), "n_pixels", "road_classes", ((bad <= 0.9) & (F.col("e") <= 0.10)).alias("accept"))


@query("F-01_accepted_tiles", f"""WITH {X.CELLS}, a AS (SELECT sid, avg(CAST(landcover IN (0, 70, 80) AS DOUBLE)) AS bad, avg(CAST(elevation IS NULL AS DOUBLE)) AS e FROM cells GROUP BY sid) SELECT sid FROM a WHERE bad <= 0.9 AND e <= 0.1""")
def accepted(spark, d):
    return tile_quality(spark, d).where("accept").select("sid")


@query("SRC-08_read_tile", f"""WITH {X.CELLS}, s AS (SELECT sid, r, c, coalesce(elevation, -9999) AS e, coalesce(road_class, -9999) AS k FROM cells) SELECT sid, r, c, nullif(e, -9999) AS elevation, CAST(coalesce(nullif(k, -9999), 0) AS SMALLINT) AS road_class FROM s""")
def read_tile(spark, d):
    stored = X.cells(spark, d).select("sid", "r", "c", F.coalesce("elevation", F.lit(-9999)).alias("e"), F.coalesce("road_class", F.lit(-9999)).alias("k"))
    return stored.select("sid", "r", "c", F.nullif("e", F.lit(-9999)).alias("elevation"), F.coalesce(F.nullif("k", F.lit(-9999)), F.lit(0)).cast("smallint").alias("road_class"))


@query("SRC-03_merge_sources", f"""WITH {X.CELLS}, s AS (SELECT r, c, sid AS source_order, elevation FROM cells) SELECT r, c, arg_max(elevation, source_order) AS elevation FROM s WHERE elevation IS NOT NULL GROUP BY r, c UNION ALL SELECT r, c, NULL FROM s GROUP BY r, c HAVING count(elevation) = 0""")
def merge(spark, d):
    return C.merge_sources(X.cells(spark, d).withColumnRenamed("sid", "source_order"), "source_order", "elevation", "r", "c")


@query("SRC-05_primary_or_fallback", f"WITH {X.CELLS} SELECT a.sid, a.r, a.c, coalesce(a.elevation, b.elevation) AS elevation FROM cells a LEFT JOIN cells b ON b.sid = a.sid + 1 AND a.r = b.r AND a.c = b.c")
def fallback(spark, d):
    """The raster of the next number stands in where a raster has no elevation."""
    c = X.cells(spark, d)
    other = c.select((F.col("sid") - 1).alias("sid"), "r", "c", F.col("elevation").alias("other"))
    return c.join(other, ["sid", "r", "c"], "left").select("sid", "r", "c", F.coalesce("elevation", "other").alias("elevation"))


@query("P-12_rescale", f"WITH {X.GRIDS} SELECT sid, r, c, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) AS f FROM grids WINDOW w AS (PARTITION BY sid)")
def rescale(spark, d):
    return C.rescale(X.grids(spark, d), "v", "f").select("sid", "r", "c", F.round("f", 6).alias("f"))


@query("P-13_field_to_resistance", f"""WITH {X.GRIDS}, f AS (SELECT sid, r, c, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS f FROM grids WINDOW w AS (PARTITION BY sid))
SELECT sid, r, c, round(pow(1000.0, f), 4) AS r_log, round(1 + 999.0 * f, 4) AS r_linear FROM f""")
def to_resistance(spark, d):
    f = C.rescale(X.grids(spark, d), "v", "f")
    return f.select("sid", "r", "c", F.round(C.field_to_resistance(F.col("f"), 1000.0), 4).alias("r_log"), F.round(C.field_to_resistance(F.col("f"), 1000.0, "linear"), 4).alias("r_linear"))


_LOG = "CASE WHEN m <= 0 THEN 0 ELSE log10(greatest(v, 0) + 1e-6 * greatest(m, 1e-300)) END"


@query("P-30_log_transform", f"WITH {X.GRIDS}, g AS (SELECT *, max(greatest(v, 0)) OVER (PARTITION BY sid) AS m FROM grids) SELECT sid, r, c, round({_LOG}, 6) AS y FROM g")
def log_transform(spark, d):
    return C.log_transform(X.grids(spark, d), "v", "y").select("sid", "r", "c", F.round("y", 6).alias("y"))


@query("P-31_inverse_transform", f"WITH {X.GRIDS}, g AS (SELECT *, max(greatest(v, 0)) OVER (PARTITION BY sid) AS m FROM grids) SELECT sid, r, c, round(pow(10.0, {_LOG}) - 1e-6 * m, 6) + 0.0 AS v FROM g")
def inverse(spark, d):
    from pyspark.sql import Window

    g = C.log_transform(X.grids(spark, d), "v", "y").withColumn("m", F.max(F.greatest("v", F.lit(0.0))).over(Window.partitionBy("sid")))
    return g.select("sid", "r", "c", (F.round(C.inverse_transform(F.col("y"), F.col("m")), 6) + 0.0).alias("v"))


_GRAD = """g AS (SELECT sid, r, c,
  (coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / ((CASE WHEN lead(v) OVER y IS NULL OR lag(v) OVER y IS NULL THEN 1.0 ELSE 2.0 END) * 100.0::DOUBLE) AS gy,
  (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / ((CASE WHEN lead(v) OVER x IS NULL OR lag(v) OVER x IS NULL THEN 1.0 ELSE 2.0 END) * 100.0::DOUBLE) AS gx
  FROM (SELECT sid, r, c, v * 1000 AS v FROM grids) WINDOW y AS (PARTITION BY sid, c ORDER BY r), x AS (PARTITION BY sid, r ORDER BY c))"""


@query("W-04_gradient_slope", f"WITH {X.GRIDS}, {_GRAD} SELECT sid, r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope_deg FROM g")
def slope(spark, d):
    e = X.grids(spark, d).withColumn("v", F.col("v") * 1000)
    return C.slope_degrees(e, "v", 100.0).select("sid", "r", "c", F.round("slope_deg", 6).alias("slope_deg"))


@query("A-30_quantiles", f"WITH {X.GRIDS} SELECT sid, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.9), 6) AS q90 FROM grids GROUP BY sid")
def quantiles(spark, d):
    q = C.quantile_edges(X.grids(spark, d), "v", [0.25, 0.9])
    return q.select("sid", F.round(F.get("edges", F.lit(0)), 6).alias("q25"), F.round(F.get("edges", F.lit(1)), 6).alias("q90"))


@query("F-05_quantile_filter", f"WITH {X.GRIDS}, q AS (SELECT sid, quantile_cont(v, 0.75) AS q FROM grids GROUP BY sid) SELECT g.sid, r, c, round(v, 6) AS v FROM grids g JOIN q USING (sid) WHERE v >= q.q")
def quantile_filter(spark, d):
    g = X.grids(spark, d)
    q = C.quantile_edges(g, "v", [0.75])
    return g.join(q, "sid").where(F.col("v") >= F.get("edges", F.lit(0))).select("sid", "r", "c", F.round("v", 6).alias("v"))


@query("W-09_digitize", f"""WITH {X.GRIDS}, q AS (SELECT sid, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS e FROM grids GROUP BY sid) SELECT sid, r, c, CAST(len(list_filter(e, lambda x: x <= v)) AS INTEGER) AS cls FROM grids JOIN q USING (sid)""")
def digitize(spark, d):
    return C.digitize(X.grids(spark, d), "v", 5).select("sid", "r", "c", "cls")


_FEAT = "f AS (SELECT sid, r, c, road_class AS k FROM cells WHERE road_class > 4 AND landcover IN (10, 20, 30))"


@query("J-13_nearest_feature", f"""WITH {X.CELLS}, {_FEAT}, d AS (SELECT c.sid, c.r, c.c, f.r AS fr, f.c AS fc, f.k, (c.r - f.r) * (c.r - f.r) + (c.c - f.c) * (c.c - f.c) AS d2 FROM cells c JOIN f ON c.sid = f.sid),
m AS (SELECT sid, r, c, min(d2) AS d2 FROM d GROUP BY sid, r, c)
SELECT c.sid, c.r, c.c, round(coalesce(sqrt(m.d2) * 100.0, 32000.0), 6) AS distance FROM cells c LEFT JOIN m ON c.sid = m.sid AND c.r = m.r AND c.c = m.c""")
def nearest(spark, d):
    c = X.cells(spark, d)
    f = c.where((F.col("road_class") > 4) & F.col("landcover").isin(10, 20, 30))
    out = C.nearest_feature(c.select("sid", "r", "c"), f, "road_class", 100.0, 32)
    return out.select("sid", "r", "c", F.round("distance", 6).alias("distance"))


_NULLS = "n AS (SELECT sid, r, c, elevation, CAST(elevation IS NULL AS INTEGER) AS gap FROM cells)"


@query("J-14_nearest_fill", f"""WITH {X.CELLS}, {_NULLS}, s AS (SELECT sid, avg(gap) AS frac FROM n GROUP BY sid),
d AS (SELECT a.sid, a.r, a.c, b.elevation, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2, b.r AS br, b.c AS bc FROM n a JOIN n b ON a.sid = b.sid AND a.gap = 1 AND b.gap = 0),
m AS (SELECT sid, r, c, min(d2) AS d2 FROM d GROUP BY ALL)
SELECT n.sid, n.r, n.c, CASE WHEN gap = 0 OR frac > 0.3 THEN NULL ELSE d2 END AS filled_from FROM n JOIN s USING (sid) LEFT JOIN m ON n.sid = m.sid AND n.r = m.r AND n.c = m.c""")
def fill(spark, d):
    c = X.cells(spark, d).select("sid", "r", "c", "elevation")
    share = c.groupBy("sid").agg(F.avg(F.col("elevation").isNull().cast("int")).alias("frac"))
    out = C.nearest_feature(c, c.where("elevation IS NOT NULL"), "elevation", 1.0, 32).join(share, "sid")
    d2 = F.round(F.col("distance") * F.col("distance")).cast("bigint")
    return out.select("sid", "r", "c", F.when(F.col("elevation").isNull() & (F.col("frac") <= 0.3), d2).alias("filled_from"))


@query("Y-05_planar_gradient", f"""WITH {X.GRIDS}, g AS (SELECT sid, r, c, r * cos(radians(30.0)) + c * sin(radians(30.0)) AS p FROM grids) SELECT sid, r, c, round((p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w), 6) AS f FROM g WINDOW w AS (PARTITION BY sid)""")
def planar(spark, d):
    a = F.radians(F.lit(30.0))
    g = X.grids(spark, d).withColumn("p", F.col("r") * F.cos(a) + F.col("c") * F.sin(a))
    return C.rescale(g, "p", "f").select("sid", "r", "c", F.round("f", 6).alias("f"))


@query("Y-06_edge_gradient", f"""WITH {X.GRIDS}, g AS (SELECT sid, r, c, r * cos(radians(30.0)) + c * sin(radians(30.0)) AS p FROM grids), n AS (SELECT sid, r, c, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) AS f FROM g WINDOW w AS (PARTITION BY sid)),
e AS (SELECT sid, r, c, 0.5 - abs(0.5 - f) AS e FROM n) SELECT sid, r, c, round((e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w), 6) AS f FROM e WINDOW w AS (PARTITION BY sid)""")
def edge(spark, d):
    a = F.radians(F.lit(30.0))
    g = C.rescale(X.grids(spark, d).withColumn("p", F.col("r") * F.cos(a) + F.col("c") * F.sin(a)), "p", "q")
    return C.rescale(g.withColumn("e", 0.5 - F.abs(0.5 - F.col("q"))), "e", "f").select("sid", "r", "c", F.round("f", 6).alias("f"))


@query("Y-09_linear_barriers", f"""WITH {X.CELLS}, l(ay, ax, th) AS (VALUES (8.0, 8.0, 0.5), (20.0, 12.0, 2.0)), b AS (
  SELECT sid, r, c, abs(-(c - ax) * sin(th) + (r - ay) * cos(th)) <= 1.0 AND NOT ((((c - ax) * cos(th) + (r - ay) * sin(th)) - 20.0 * floor(((c - ax) * cos(th) + (r - ay) * sin(th)) / 20.0)) >= 16.0) AS hit FROM cells, l)
SELECT sid, r, c, bool_or(hit) AS barrier FROM b GROUP BY sid, r, c""")
def barriers(spark, d):
    hits = []
    for ay, ax, th in ((8.0, 8.0, 0.5), (20.0, 12.0, 2.0)):
        dx, dy = F.cos(F.lit(th)), F.sin(F.lit(th))
        perp = F.abs(-(F.col("c") - ax) * dy + (F.col("r") - ay) * dx)
        along = (F.col("c") - ax) * dx + (F.col("r") - ay) * dy
        hits.append((perp <= 1.0) & ~(F.pmod(along, F.lit(20.0)) >= 16.0))
    return X.cells(spark, d).select("sid", "r", "c", (hits[0] | hits[1]).alias("barrier"))


@query("P-37_chebyshev", f"WITH {X.CELLS} SELECT sid, r, c, greatest(abs(r - 16), abs(c - 16)) AS cheb FROM cells")
def chebyshev(spark, d):
    return X.cells(spark, d).select("sid", "r", "c", F.greatest(F.abs(F.col("r") - 16), F.abs(F.col("c") - 16)).alias("cheb"))


@query("P-40_suitability", f"WITH {X.CELLS}, {SURFACE} SELECT sid, r, c, round(CASE WHEN nodata THEN 0 ELSE (1.0 / CAST(resistance AS DOUBLE)) * (1.0 / CAST(resistance AS DOUBLE)) END, 9) AS s FROM surface WHERE table_id = 'large_mammal'")
def suitability(spark, d):
    inv = 1.0 / F.col("resistance").cast("double")
    return surface(spark, d).where("table_id = 'large_mammal'").select("sid", "r", "c", F.round(F.when(F.col("nodata"), 0.0).otherwise(inv * inv), 9).alias("s"))
