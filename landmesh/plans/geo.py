"""Queries on places, grids, blocks and ids (P-01 to P-11, P-22, P-23, P-26, P-27, P-41)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..sources import fixtures as X
from .registry import query

LAT, LON, HALF, PX = F.col, F.col, F.col, F.col
DEG = f"{K.METRES_PER_DEGREE}::DOUBLE"
BLOCK_SQL = f"""
bands AS (SELECT CAST(b AS BIGINT) AS band, greatest(1, CAST(round_even(360 * cos(radians((b + 0.5) * {K.BAND_DEG} - 90)) / {K.BAND_DEG}, 0) AS BIGINT)) AS n FROM range(9) t(b)),
blocked AS (
  SELECT t.*, b.band, b.n, printf('b%03d_%03d', b.band, CAST(floor(((lon + 180) - 360 * floor((lon + 180) / 360)) / (360.0::DOUBLE / n)) AS BIGINT) % n) AS block_id
  FROM tiles t JOIN bands b ON b.band = least(greatest(CAST(floor((lat + 90) / {K.BAND_DEG}) AS BIGINT), 0), 8)
)"""
FOOT_SQL = f"""
f0 AS (SELECT tile_id, lon, half_m, greatest(lat - half_m / {DEG}, -90.0) AS a, least(lat + half_m / {DEG}, 89.999) AS b FROM tiles),
f1 AS (
  SELECT tile_id, lon, half_m, bands.band, n, least(greatest(abs(greatest(a, bands.band * {K.BAND_DEG} - 90)), abs(least(b, (bands.band + 1) * {K.BAND_DEG} - 90))), 89.0) AS worst
  FROM f0 JOIN bands ON bands.band BETWEEN least(greatest(CAST(floor((a + 90) / {K.BAND_DEG}) AS BIGINT), 0), 8) AND least(greatest(CAST(floor((b + 90) / {K.BAND_DEG}) AS BIGINT), 0), 8)
), f2 AS (
  SELECT tile_id, band, n, CAST(floor((lon - d + 180) / (360.0::DOUBLE / n)) AS BIGINT) AS j0, CAST(floor((lon + d + 180) / (360.0::DOUBLE / n)) AS BIGINT) AS j1
  FROM (SELECT *, half_m / ({DEG} * greatest(cos(radians(worst)), 0.02)) AS d FROM f1)
), foot AS (
  SELECT DISTINCT tile_id, printf('b%03d_%03d', band, ((j % n) + n) % n) AS block
  FROM (SELECT tile_id, band, n, unnest(CASE WHEN j1 - j0 + 1 >= n THEN range(0, n) ELSE range(j0, j1 + 1) END) AS j FROM f2)
)"""
BOX_SQL = f"""
boxes AS (
  SELECT *, lat - dlat AS lat0, lat + dlat AS lat1, lon - dlon AS lon0, lon + dlon AS lon1 FROM (
    SELECT *, half_m / ({DEG} * greatest(cos(radians(least(greatest(abs(lat - dlat), abs(lat + dlat)), 89.0))), 0.02)) AS dlon
    FROM (SELECT *, half_m / {DEG} AS dlat FROM tiles))
)"""


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("P-01_utm_epsg", f"WITH {X.TILES} SELECT tile_id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS BIGINT) AS epsg FROM tiles")
def utm(spark, d):
    return X.tiles(spark, d).select("tile_id", G.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


_SNAP = f"""snapped AS (
  SELECT tile_id, size, pixel_m, floor((lon * {DEG} - half_m) / pixel_m) * pixel_m AS left_m, ceil((lat * {DEG} + half_m) / pixel_m) * pixel_m AS top_m FROM tiles)"""


def _snapped(spark, d):
    t = X.tiles(spark, d)
    left, top = G.snapped_origin(F.col("lon") * K.METRES_PER_DEGREE, F.col("lat") * K.METRES_PER_DEGREE, F.col("half_m"), F.col("pixel_m"))
    return t.select("tile_id", "size", "pixel_m", left.alias("left_m"), top.alias("top_m"))


@query("P-02_grid_snap", f"WITH {X.TILES}, {_SNAP} SELECT tile_id, CAST(left_m AS DOUBLE) AS left_m, CAST(top_m AS DOUBLE) AS top_m FROM snapped")
def snap(spark, d):
    return _snapped(spark, d).select("tile_id", "left_m", "top_m")


@query("P-03_hemisphere_codes", f"""WITH {X.TILES}, k AS (SELECT tile_id, CAST(floor(lat) AS BIGINT) AS a, CAST(floor(lon) AS BIGINT) AS o FROM tiles)
SELECT tile_id, CASE WHEN a >= 0 THEN printf('N%02d', a) ELSE printf('S%02d', -a) END || CASE WHEN o >= 0 THEN printf('E%03d', o) ELSE printf('W%03d', -o) END AS code FROM k""")
def codes(spark, d):
    return X.tiles(spark, d).select("tile_id", G.degree_code(F.floor("lat"), F.floor("lon")).alias("code"))


@query("P-04_tile_bounds", f"WITH {X.TILES}, {_SNAP} SELECT tile_id, left_m, top_m - size * pixel_m AS bottom_m, left_m + size * pixel_m AS right_m, top_m FROM snapped")
def bounds(spark, d):
    w = F.col("size") * F.col("pixel_m")
    return _snapped(spark, d).select("tile_id", "left_m", (F.col("top_m") - w).alias("bottom_m"), (F.col("left_m") + w).alias("right_m"), "top_m")


def _keys_sql(step: int) -> str:
    code = "CASE WHEN a >= 0 THEN printf('N%02d', a) ELSE printf('S%02d', -a) END || CASE WHEN o >= 0 THEN printf('E%03d', o) ELSE printf('W%03d', -o) END"
    lo = lambda c: f"CAST(floor({c} / {step}) AS BIGINT) * {step}"
    return f"""WITH {X.TILES}, {BOX_SQL}, a AS (SELECT tile_id, lon0, lon1, unnest(range({lo('lat0')}, {lo('lat1')} + 1, {step})) AS a FROM boxes WHERE tier = 'S'),
    o AS (SELECT tile_id, a, unnest(range({lo('lon0')}, {lo('lon1')} + 1, {step})) AS o FROM a)
    SELECT tile_id, {code} AS code FROM o WHERE a >= -90 AND a < 90 AND o >= -180 AND o < 180"""


def _keys(spark, d, step):
    t = X.tiles(spark, d).where("tier = 'S'")
    b = G.tile_box(F.col("lat"), F.col("lon"), F.col("half_m"))
    return G.degree_cells(t, (b["lat0"], b["lat1"], b["lon0"], b["lon1"]), step).select("tile_id", G.degree_code(F.col("cell_lat"), F.col("cell_lon")).alias("code"))


@query("P-05_three_degree_keys", _keys_sql(3))
def keys3(spark, d):
    return _keys(spark, d, 3)


@query("P-06_one_degree_keys", _keys_sql(1))
def keys1(spark, d):
    return _keys(spark, d, 1)


@query("P-07_block_id", f"WITH {X.TILES}, {BLOCK_SQL} SELECT tile_id, band, n AS n_lon, block_id FROM blocked")
def block_id(spark, d):
    b = G.Blocks()
    band = b.band(F.col("lat"))
    return X.tiles(spark, d).select("tile_id", band.alias("band"), b.cells(band).alias("n_lon"), b.id(F.col("lat"), F.col("lon")).alias("block_id"))


@query("P-08_cell_bounds", f"""WITH {X.TILES}, {BLOCK_SQL} SELECT DISTINCT block_id, CAST(round(band * {K.BAND_DEG} - 90, 6) AS DOUBLE) AS lat0, CAST(round((band + 1) * {K.BAND_DEG} - 90, 6) AS DOUBLE) AS lat1,
  round(CAST(substr(block_id, 6, 3) AS BIGINT) * (360.0::DOUBLE / n) - 180, 6) AS lon0, round((CAST(substr(block_id, 6, 3) AS BIGINT) + 1) * (360.0::DOUBLE / n) - 180, 6) AS lon1 FROM blocked""")
def cell_bounds(spark, d):
    b = G.Blocks()
    t = X.tiles(spark, d).select(b.id(F.col("lat"), F.col("lon")).alias("block_id")).distinct()
    return t.select("block_id", *[F.round(v, 6).cast("double").alias(k) for k, v in b.bounds(F.col("block_id")).items()])


@query("P-09_footprint_blocks", f"WITH {X.TILES}, {BLOCK_SQL}, {FOOT_SQL} SELECT tile_id, block FROM foot")
def footprint(spark, d):
    return G.Blocks().footprint(X.tiles(spark, d), "tile_id")


@query("P-10_fits_one_block", f"WITH {X.TILES}, {BLOCK_SQL}, {FOOT_SQL} SELECT tile_id, count(*) = 1 AS fits FROM foot GROUP BY tile_id")
def fits(spark, d):
    return G.Blocks().footprint(X.tiles(spark, d), "tile_id").groupBy("tile_id").agg((F.count(F.lit(1)) == 1).alias("fits"))


@query("P-10b_interior_bounds", f"""WITH {X.TILES}, {BLOCK_SQL}, c AS (
  SELECT tile_id, half_m, CAST(band * {K.BAND_DEG} - 90 AS DOUBLE) AS a0, CAST((band + 1) * {K.BAND_DEG} - 90 AS DOUBLE) AS a1, CAST(substr(block_id, 6, 3) AS BIGINT) * (360.0::DOUBLE / n) - 180 AS o0, (CAST(substr(block_id, 6, 3) AS BIGINT) + 1) * (360.0::DOUBLE / n) - 180 AS o1 FROM blocked
), e AS (SELECT *, half_m / {DEG} AS dlat, half_m / ({DEG} * greatest(cos(radians(least(greatest(abs(a0), abs(a1)), 89.0))), 0.02)) AS dlon FROM c),
b AS (SELECT tile_id, a0 + dlat AS lat0, a1 - dlat AS lat1, o0 + dlon AS lon0, o1 - dlon AS lon1 FROM e)
SELECT tile_id, CASE WHEN lat0 < lat1 AND lon0 < lon1 THEN round(lat0, 6) END AS lat0, CASE WHEN lat0 < lat1 AND lon0 < lon1 THEN round(lat1, 6) END AS lat1,
  CASE WHEN lat0 < lat1 AND lon0 < lon1 THEN round(lon0, 6) END AS lon0, CASE WHEN lat0 < lat1 AND lon0 < lon1 THEN round(lon1, 6) END AS lon1 FROM b""")
def interior(spark, d):
    b = G.Blocks()
    t = X.tiles(spark, d).withColumn("block", b.id(F.col("lat"), F.col("lon")))
    box = b.bounds(F.col("block"))
    worst = F.least(F.greatest(F.abs(box["lat0"]), F.abs(box["lat1"])), F.lit(89.0))
    dlat = F.col("half_m") / K.METRES_PER_DEGREE
    dlon = F.col("half_m") / (F.lit(K.METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(worst)), F.lit(0.02)))
    t = t.select("tile_id", (box["lat0"] + dlat).alias("lat0"), (box["lat1"] - dlat).alias("lat1"), (box["lon0"] + dlon).alias("lon0"), (box["lon1"] - dlon).alias("lon1"))
    ok = (F.col("lat0") < F.col("lat1")) & (F.col("lon0") < F.col("lon1"))
    return t.select("tile_id", *[F.when(ok, F.round(c, 6)).alias(c) for c in ("lat0", "lat1", "lon0", "lon1")])


@query("P-11_tile_box", f"WITH {X.TILES}, {BOX_SQL} SELECT tile_id, {q6('lat0', 'lat1', 'lon0', 'lon1')} FROM boxes")
def box(spark, d):
    b = G.tile_box(F.col("lat"), F.col("lon"), F.col("half_m"))
    return X.tiles(spark, d).select("tile_id", *[F.round(v, 6).alias(k) for k, v in b.items()])


_SPACE = K.SAMPLE_NAMESPACE.replace("-", "")


@query("P-22_sample_uuid", f"""WITH h AS (SELECT o_orderkey, sha1(unhex('{_SPACE}') || encode('demo|synthetic|S:' || CAST(o_orderkey AS VARCHAR))) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ('{{0:8,1:9,2:a,3:b,4:8,5:9,6:a,7:b,8:8,9:9,a:a,b:b,c:8,d:9,e:a,f:b}}')[strpos('{{0:8,1:9,2:a,3:b,4:8,5:9,6:a,7:b,8:8,9:9,a:a,b:b,c:8,d:9,e:a,f:b}}', substr(h, 17, 1) || ':') + 2] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS sample_id FROM h""")
def uuid5(spark, d):
    o = X.table(spark, d, "orders")
    return o.select("o_orderkey", G.sample_uuid(F.lit("demo"), F.lit("synthetic"), F.concat(F.lit("S:"), F.col("o_orderkey").cast("string"))).alias("sample_id"))


@query("P-23_synthetic_split", f"""WITH {X.INDEX}, h AS (SELECT DISTINCT sample_id, seed, CAST('0x' || substr(sha256('{K.SPLIT_SEED}|synthetic|' || seed), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM idx)
SELECT sample_id, seed, CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test_id' END AS split FROM h""")
def synthetic_split(spark, d):
    i = X.index(spark, d).select("sample_id", "seed").distinct()
    share = G.hash_share(F.lit(str(K.SPLIT_SEED)), F.lit("synthetic"), F.col("seed").cast("string"))
    return i.select("sample_id", "seed", G.split_of(share).alias("split"))


_REALMS = "CASE realm WHEN 'AFRICA' THEN 'Afrotropic' WHEN 'AMERICA' THEN 'Nearctic' WHEN 'ASIA' THEN 'Indomalayan' WHEN 'EUROPE' THEN 'Palearctic' ELSE 'Antarctica' END"


@query("P-26_road_region", f"""WITH {X.TILES}, t AS (SELECT tile_id, lat, lon, {_REALMS} AS realm FROM tiles)
SELECT tile_id, realm, CAST(CASE WHEN realm = 'Palearctic' THEN CASE WHEN lon < 60 AND lat > 35 THEN 4 WHEN lon < 100 THEN 5 ELSE 6 END ELSE {X.case('realm', K.ROAD_REGION)} END AS INTEGER) AS region FROM t""")
def road_region(spark, d):
    t = X.tiles(spark, d).withColumn("realm", F.expr(_REALMS))
    table = F.create_map(*[F.lit(x) for kv in K.ROAD_REGION.items() for x in kv])
    east = F.when((F.col("lon") < 60) & (F.col("lat") > 35), 4).when(F.col("lon") < 100, 5).otherwise(6)
    return t.select("tile_id", "realm", F.when(F.col("realm") == "Palearctic", east).otherwise(F.try_element_at(table, F.col("realm"))).cast("int").alias("region"))


@query("P-41_tile_name", f"WITH {X.TILES} SELECT tile_id, printf('%s_%s_b%02d_%04d', tier, lower(substr(realm, 1, 3)), biome_num, c_custkey) AS name FROM tiles")
def tile_name(spark, d):
    return X.tiles(spark, d).select("tile_id", F.format_string("%s_%s_b%02d_%04d", "tier", F.lower(F.substring("realm", 1, 3)), "biome_num", "c_custkey").alias("name"))
