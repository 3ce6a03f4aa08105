"""Queries on remaining sources and sinks: keyed tiles, stored surfaces, ledgers, pictures, chunked arrays."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import polygons as P
from ..operators.shared import shared_folder
from ..sources import config as Y
from ..sources import fixtures as X
from ..sources import images as M
from .geo import _keys, _keys_sql
from .network import signed_round
from .numeric import _POLY, polygons
from .registry import query
from .surfaces import SURFACE, surface

_CODE = "CASE WHEN a >= 0 THEN printf('N%02d', a) ELSE printf('S%02d', -a) END || CASE WHEN o >= 0 THEN printf('E%03d', o) ELSE printf('W%03d', -o) END"


@query("SRC-04_land_cover_keys", f"""WITH {X.TILES}, k AS ({_keys_sql(3).replace(f'WITH {X.TILES},', 'WITH ')}), h AS (SELECT DISTINCT {_CODE} AS code, true AS there FROM (SELECT CAST(floor(lat / 3) AS BIGINT) * 3 AS a, CAST(floor(lon / 3) AS BIGINT) * 3 AS o FROM tiles WHERE tier <> 'S'))
SELECT tile_id, count(*) AS asked, count(there) AS found, max(CASE WHEN there THEN code END) AS last FROM k LEFT JOIN h USING (code) GROUP BY tile_id""")
def land_cover_keys(spark, d):
    """The three-degree sources that each small tile asks for, and those of them that there are."""
    t = X.tiles(spark, d).where("tier <> 'S'")
    three = lambda c: F.floor(F.col(c) / 3) * 3
    have = t.select(G.degree_code(three("lat"), three("lon")).alias("code")).distinct().withColumn("there", F.lit(True))
    return _keys(spark, d, 3).join(have, "code", "left").groupBy("tile_id").agg(F.count(F.lit(1)).alias("asked"), F.count("there").alias("found"), F.max(F.when(F.col("there"), F.col("code"))).alias("last"))


@query("SRC-06_global_raster", f"""WITH {X.TILES}, g AS (SELECT CAST(floor(lat / 5) AS BIGINT) AS r, CAST(floor(lon / 5) AS BIGINT) AS c, max(biome_num) AS v FROM tiles GROUP BY ALL), s AS (SELECT tile_id, i, j, CAST(floor((lat + i * 2.5::DOUBLE) / 5) AS BIGINT) AS r, CAST(floor((lon + j * 2.5::DOUBLE) / 5) AS BIGINT) AS c FROM tiles, range(-1, 2) a(i), range(-1, 2) b(j))
SELECT tile_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, v FROM s LEFT JOIN g USING (r, c)""")
def global_raster(spark, d):
    """A raster of five-degree cells read at nine places around each tile; null where it has none."""
    t = X.tiles(spark, d)
    cell = lambda c: F.floor(c / 5)
    g = t.groupBy(cell(F.col("lat")).alias("r"), cell(F.col("lon")).alias("c")).agg(F.max("biome_num").alias("v"))
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    s = t.select("tile_id", "lat", "lon", offsets)
    s = s.select("tile_id", "o.i", "o.j", cell(F.col("lat") + F.col("o.i") * 2.5).alias("r"), cell(F.col("lon") + F.col("o.j") * 2.5).alias("c"))
    return s.join(g, ["r", "c"], "left").select("tile_id", "i", "j", "v")


@query("SRC-09_stored_surfaces", f"WITH {X.CELLS}, {SURFACE} SELECT sid, table_id, max(r_max) AS r_max, count(*) AS cells, count(*) FILTER (nodata) AS nodata, round(sum(CAST(resistance AS DOUBLE)), 3) AS total FROM surface GROUP BY ALL")
def stored_surfaces(spark, d):
    """Surfaces written with their two bands and tags, by table, and read again."""
    folder = shared_folder(spark, "surfaces")
    s = surface(spark, d)
    tags = F.create_map(F.lit("table_id"), F.col("table_id"), F.lit("r_max"), F.col("r_max").cast("string"))
    s.withColumn("tags", tags).drop("r_max").write.partitionBy("table_id").parquet(folder)
    back = spark.read.parquet(folder)
    return back.groupBy("sid", "table_id").agg(F.max(F.col("tags")["r_max"].cast("double")).alias("r_max"), F.count(F.lit(1)).alias("cells"), F.count_if("nodata").alias("nodata"), F.round(F.sum(F.col("resistance").cast("double")), 3).alias("total"))


@query("SRC-12_cluster_profile", "SELECT * FROM (VALUES ('spark.executor.cores', '4'), ('spark.executor.memory', '8g'), ('spark.dynamicAllocation.maxExecutors', '20')) t(key, value)")
def cluster_profile(spark, d):
    return spark.createDataFrame(list(Y.spark_settings(Y.profile("small", os.path.join(Y.HOME, "clusters"))).items()), "key string, value string")


@query("SRC-14_polygon_edges", f"WITH {_POLY} SELECT * FROM poly")
def polygon_edges(spark, d):
    """Regions kept as WKT and read as edges."""
    e = polygons(spark, d)
    xy = lambda a, b: F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string"))
    turns = e.withColumn("k", F.pmod(F.monotonically_increasing_id(), F.lit(4)))
    rings = turns.groupBy("poly").agg(F.array_sort(F.collect_list(F.struct("k", xy("x0", "y0").alias("a"), xy("x1", "y1").alias("b")))).alias("s"))
    wkt = F.concat(F.lit("POLYGON (("), F.array_join(F.col("s.a"), ", "), F.lit(", "), F.element_at("s.b", -1), F.lit("))"))
    return P.edges_of_wkt(rings.select("poly", wkt.alias("wkt")))


_HELD = "held AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS bytes FROM part WHERE p_partkey % 3 = 0)"


def _held(spark, d):
    """What a store holds already: every third file, some of another size."""
    p = X.table(spark, d, "part").where("p_partkey % 3 = 0")
    return p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("bytes"))


@query("SRC-16_download_ledger", f"WITH {_HELD} SELECT p_partkey AS key, p_size AS bytes FROM part WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.key = p_partkey AND held.bytes = p_size)")
def download_ledger(spark, d):
    """Files that a ledger lacks by name and size, which is what a download would fetch."""
    want = X.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("bytes"))
    return want.join(_held(spark, d), ["key", "bytes"], "left_anti")


@query("SNK-13_push_manifest", f"WITH {_HELD} SELECT p_partkey AS key, CASE WHEN held.key IS NULL THEN 'new' WHEN held.bytes <> p_size THEN 'changed' ELSE 'same' END AS state FROM part LEFT JOIN held ON held.key = p_partkey")
def push_manifest(spark, d):
    """What a push would do to each file; nothing is sent."""
    have = _held(spark, d).withColumnRenamed("bytes", "held")
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("bytes")).join(have, "key", "left")
    return p.select("key", F.when(F.col("held").isNull(), "new").when(F.col("held") != F.col("bytes"), "changed").otherwise("same").alias("state"))


@query("SNK-16_quicklooks", f"WITH {X.GRIDS} SELECT sid, r, c, CAST(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255 + 0.5) AS BIGINT) AS gray FROM grids WINDOW w AS (PARTITION BY sid)")
def quicklooks(spark, d):
    """Pictures of the small rasters, read again."""
    return M.read_quicklooks(M.quicklooks(X.grids(spark, d).select("sid", "r", "c", "v"), "v"))


@query("SNK-09_chunked_arrays", f"WITH {X.GRIDS} SELECT sid, r, c, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS value FROM grids")
def chunked_arrays(spark, d):
    """The small rasters as chunked arrays in a folder, read again."""
    arrays = M.write_zarr(X.grids(spark, d).select("sid", "r", "c", "v"), "v", shared_folder(spark, "zarr"))
    return M.read_zarr(arrays).select("sid", "r", "c", F.round("value", 6).alias("value"))


@query("SNK-19_column_order", f"WITH {X.GRIDS} SELECT sid, list(round(v, 6) ORDER BY c, r) AS a FROM grids GROUP BY sid")
def column_order(spark, d):
    """Rasters as arrays in column-major order, as solvers in other languages take them."""
    items = F.array_sort(F.collect_list(F.struct("c", "r", signed_round(F.col("v")).alias("v"))))
    return X.grids(spark, d).groupBy("sid").agg(items.alias("a")).select("sid", F.col("a.v").alias("a"))
