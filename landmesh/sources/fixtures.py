"""Domain relations derived from the TPC-H-like tables, in Spark and in SQL.

Each adapter has a DataFrame function and a text of common table expressions for the
SQL oracle; both use integer arithmetic, so they agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(column: str, values: dict, other: str = "NULL") -> str:
    """A CASE over literal keys, valid in both engines."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + f" ELSE {other} END"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landscapes of 32 by 32 covariate cells, one for every ten suppliers (null: outside the data)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.expr("l_suppkey DIV 10").alias("sid"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 32).alias("r"),
        ((F.col("l_partkey") * 17 + F.col("l_linenumber") * 5) % 32).alias("c"),
        F.col("l_linenumber").cast("bigint").alias("ln"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_orderkey").alias("ok"),
    )
    agg = li.groupBy("sid", "r", "c").agg(F.sum("ln").alias("sl"), F.sum("q").alias("sq"), F.max("ok").alias("mo"))
    grid = agg.select("sid").distinct().select("sid", F.explode(F.expr("sequence(0L, 31L)")).alias("r")).select("sid", "r", F.explode(F.expr("sequence(0L, 31L)")).alias("c"))
    ix = F.expr("CASE WHEN sl IS NULL OR sl % 11 = 0 THEN 0 ELSE sq % 11 + 1 END").cast("int")
    return grid.join(agg, ["sid", "r", "c"], "left").select(
        "sid", "r", "c", F.get(F.array(*[F.lit(x) for x in K.LANDCOVER]), ix).cast("bigint").alias("landcover"),
        F.expr("mo % 60").alias("slope"), F.expr("mo % 6").alias("road_class"), F.expr("(sq * 37) % 3000").alias("road_distance"),
        F.expr("CAST(sq % 101 AS DOUBLE) / 100.0D").alias("ghm"), F.expr("(mo * 13) % 5000").alias("elevation"),
    )


CELLS = f"""
fx_a AS (
  SELECT l_suppkey // 10 AS sid, (l_orderkey * 31 + l_linenumber * 7) % 32 AS r, (l_partkey * 17 + l_linenumber * 5) % 32 AS c,
    CAST(sum(l_linenumber) AS BIGINT) AS sl, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sq, max(l_orderkey) AS mo
  FROM lineitem GROUP BY 1, 2, 3
), fx_g AS (
  SELECT s.sid, r.x AS r, c.x AS c FROM (SELECT DISTINCT sid FROM fx_a) s, range(32) r(x), range(32) c(x)
), cells AS (
  SELECT g.sid, g.r, g.c, CAST(({K.LANDCOVER})[CASE WHEN sl IS NULL OR sl % 11 = 0 THEN 0 ELSE sq % 11 + 1 END + 1] AS BIGINT) AS landcover,
    mo % 60 AS slope, mo % 6 AS road_class, (sq * 37) % 3000 AS road_distance, CAST(sq % 101 AS DOUBLE) / 100.0::DOUBLE AS ghm, (mo * 13) % 5000 AS elevation
  FROM fx_g g LEFT JOIN fx_a a ON g.sid = a.sid AND g.r = a.r AND g.c = a.c
)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 by 8 raster per embedding, all cells valid."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return e.select(F.col("vec_id").alias("sid"), "label", F.expr("CAST(pos DIV 8 AS BIGINT)").alias("r"), F.expr("CAST(pos % 8 AS BIGINT)").alias("c"), F.col("v").cast("double").alias("v"))


GRIDS = """
grids AS (
  SELECT vec_id AS sid, label, CAST((p - 1) // 8 AS BIGINT) AS r, CAST((p - 1) % 8 AS BIGINT) AS c, CAST(embedding[p] AS DOUBLE) AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)
)"""

_TILE = f"""'T' || CAST(c_custkey AS STRING) AS tile_id, c_custkey,
    CASE WHEN c_custkey % 40 = 0 THEN 'XXL' WHEN c_custkey % 4 = 0 THEN 'S' WHEN c_custkey % 4 = 1 THEN 'M' WHEN c_custkey % 4 = 2 THEN 'L' ELSE 'XL' END AS tier,
    CAST((c_custkey * 7919) % 12500 AS DOUBLE) / 100.0 - 55.0 AS lat, CAST((c_custkey * 104729) % 36000 AS DOUBLE) / 100.0 - 180.0 AS lon,
    r_name AS realm, CAST(c_nationkey % 14 + 1 AS BIGINT) AS biome_num, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 1000.0 AS ghm"""
_SIZES = f"{case('tier', K.TIER_SIZE)} AS size, CAST({case('tier', K.TIER_PIXEL_M)} AS DOUBLE) AS pixel_m"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One real tile per customer: place, tier, realm, biome and human modification."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    t = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    parts = _TILE.replace(" / 100.0", " / 100.0D").replace("/ 1000.0", "/ 1000.0D").replace("- 55.0", "- 55.0D").replace("- 180.0", "- 180.0D")
    t = t.selectExpr(*_split(parts))
    return t.selectExpr("*", *_split(_SIZES)).withColumn("half_m", F.col("size") * F.col("pixel_m") / F.lit(2.0))


def _split(text: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in (*out, text[last:])]


_D = lambda s: s.replace("/ 100.0", "/ 100.0::DOUBLE").replace("/ 1000.0", "/ 1000.0::DOUBLE").replace("- 55.0", "- 55.0::DOUBLE").replace("- 180.0", "- 180.0::DOUBLE")
TILES = f"""
fx_t AS (
  SELECT {_D(_TILE)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), tiles AS (
  SELECT *, size * pixel_m / 2.0::DOUBLE AS half_m FROM (SELECT *, {_SIZES} FROM fx_t)
)"""

_INDEX = f"""o_orderkey DIV 5 AS sample_id, {case('o_orderkey % 5', dict(enumerate(K.CONFIGS)))} AS config,
    {case('(o_orderkey DIV 5) % 5', dict(enumerate(K.TIER_SIZE)))} AS tier,
    CASE WHEN (o_orderkey DIV 25) % 10 < 6 THEN 'synthetic' ELSE 'real' END AS family,
    20260905 + o_orderkey DIV 5 AS seed, {case('(o_orderkey DIV 5) % 6', {i: 10 ** (i + 1) for i in range(6)})} AS contrast,
    o_totalprice / 100000 AS solve_time_s,
    CASE WHEN o_orderstatus = 'P' THEN 'not_converged' WHEN o_orderpriority = '1-URGENT' THEN 'fallback_solver' WHEN o_orderpriority = '5-LOW' THEN 'rmax_saturated' ELSE '' END AS qc_flags,
    {case('(o_orderkey DIV 5) % 5', dict(enumerate(K.TABLE_NAMES)))} AS resistance_table_id,
    CAST(o_custkey % 4000 AS BIGINT) AS maxrss_mb"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample and source configuration."""
    i = table(spark, sf_dir, "orders").selectExpr(*_split(_INDEX))
    return i.selectExpr("*", f"{case('config', K.KIND_OF)} AS kind")


INDEX = f"""
fx_i AS (SELECT {_INDEX.replace(' DIV ', ' // ')} FROM orders),
idx AS (SELECT *, {case('config', K.KIND_OF)} AS kind FROM fx_i)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of solver runs from the events table."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("started"), "user_id", F.col("event_type").alias("state"), F.col("value").alias("seconds"), "props")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed for every hundred customers."""
    return table(spark, sf_dir, "customer").select((F.expr("c_custkey DIV 100") + 20260905).alias("seed")).distinct()


SEEDS = "seeds AS (SELECT DISTINCT 20260905 + c_custkey // 100 AS seed FROM customer)"
