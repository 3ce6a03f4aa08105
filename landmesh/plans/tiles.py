"""Queries on sampling, splits and joins of tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..operators import sampling as S
from ..operators import splits as L
from ..sources import fixtures as X
from .geo import BLOCK_SQL, BOX_SQL, FOOT_SQL
from .registry import query

_TERC = "e AS (SELECT quantile_cont(ghm, 1.0 / 3) AS e1, quantile_cont(ghm, 2.0 / 3) AS e2 FROM tiles), terc AS (SELECT tiles.*, CASE WHEN ghm <= e1 THEN 0 WHEN ghm <= e2 THEN 1 ELSE 2 END AS tercile FROM tiles, e), strata AS (SELECT *, printf('B%02d|%s|H%d', biome_num, realm, tercile) AS stratum FROM terc)"


def strata(spark, d):
    return S.with_terciles(X.tiles(spark, d), "ghm").withColumn("stratum", S.stratum())


@query("P-28_terciles", f"WITH {X.TILES}, {_TERC} SELECT tile_id, CAST(tercile AS INTEGER) AS tercile FROM terc")
def terciles(spark, d):
    return strata(spark, d).select("tile_id", F.col("tercile").cast("int").alias("tercile"))


@query("P-27_stratum", f"WITH {X.TILES}, {_TERC} SELECT tile_id, stratum FROM strata")
def stratum(spark, d):
    return strata(spark, d).select("tile_id", "stratum")


@query("W-01_round_robin", f"""WITH {X.TILES}, {_TERC}, w AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('5|' || stratum || '|' || tile_id), tile_id) AS turn FROM strata)
SELECT tile_id, stratum, turn FROM w ORDER BY turn, sha256('5|' || stratum), stratum LIMIT 60""")
def round_robin(spark, d):
    return S.round_robin(strata(spark, d), 60, "tile_id", 5).select("tile_id", "stratum", F.col("turn").cast("bigint").alias("turn"))


_STRATA = "homes AS (SELECT block_id AS block, realm, count(*) AS n FROM blocked GROUP BY ALL), bests AS (SELECT block, first(realm ORDER BY n DESC, realm) AS stratum FROM homes GROUP BY block), bs AS (SELECT f.block, coalesce(stratum, 'all') AS stratum FROM (SELECT DISTINCT block FROM foot) f LEFT JOIN bests USING (block))"


def _assign(source: str, seed: int) -> str:
    return f"""(SELECT block, stratum, CASE WHEN k < n - v - t THEN 'train' WHEN k < n - t THEN 'val' ELSE 'test_id' END AS split FROM (
      SELECT *, round_even(n * 0.1::DOUBLE, 0) AS v, round_even(n * 0.1::DOUBLE, 0) AS t FROM (
        SELECT block, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{seed}|' || stratum || '|' || block), block) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM {source})))"""


@query("W-02_fraction_cut", f"WITH {X.TILES}, {BLOCK_SQL}, {FOOT_SQL}, {_STRATA} SELECT block, stratum, split FROM {_assign('bs', K.SPLIT_SEED)}")
def fraction_cut(spark, d):
    return L.assign_blocks(L.block_strata(X.tiles(spark, d)), K.SPLIT_SEED)


@query("A-13_group_mode", f"WITH {X.TILES}, {BLOCK_SQL}, homes AS (SELECT block_id, realm, count(*) AS n FROM blocked GROUP BY ALL) SELECT block_id, first(realm ORDER BY n DESC, realm) AS realm FROM homes GROUP BY block_id")
def group_mode(spark, d):
    b = G.Blocks()
    t = X.tiles(spark, d).withColumn("block_id", b.id(F.col("lat"), F.col("lon")))
    return t.groupBy("block_id").agg(F.mode("realm", True).alias("realm"))


_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test_id' THEN 2 ELSE 3 END"


@query("L-01_footprint_rule", f"WITH {X.TILES}, {BLOCK_SQL}, {FOOT_SQL}, {_STRATA}, asg AS {_assign('bs', K.SPLIT_SEED)} SELECT tile_id, arg_max(split, {_RANK}) AS split FROM foot JOIN asg USING (block) GROUP BY tile_id")
def footprint_rule(spark, d):
    t = X.tiles(spark, d)
    return L.footprint_rule(t, L.assign_blocks(L.block_strata(t), K.SPLIT_SEED))


_MEET = "a.lat1 > b.lat0 AND b.lat1 > a.lat0 AND a.lon1 > b.lon0 AND b.lon1 > a.lon0"


@query("J-08_boxes_intersect", f"WITH {X.TILES}, {BOX_SQL} SELECT a.tile_id AS a, b.tile_id AS b FROM boxes a JOIN boxes b ON {_MEET} WHERE a.tier <> 'XXL' AND b.tier = 'XXL'")
def boxes_intersect(spark, d):
    b = L.with_boxes(X.tiles(spark, d))
    return L.boxes_meet(b.where("tier <> 'XXL'"), b.where("tier = 'XXL'"), "tile_id").select("a", "b")


@query("J-09_box_contained", f"WITH {X.TILES}, {BOX_SQL} SELECT a.tile_id AS a, b.tile_id AS b FROM boxes a JOIN boxes b ON {_MEET} AND a.lat0 >= b.lat0 AND a.lat1 <= b.lat1 AND a.lon0 >= b.lon0 AND a.lon1 <= b.lon1 WHERE a.tier <> 'XXL' AND b.tier = 'XXL'")
def box_contained(spark, d):
    b = L.with_boxes(X.tiles(spark, d))
    return L.boxes_meet(b.where("tier <> 'XXL'"), b.where("tier = 'XXL'"), "tile_id").where("inside").select("a", "b")


_REG = f"""links AS (SELECT a.tile_id AS a, b.tile_id AS b FROM boxes a JOIN boxes b ON {_MEET} WHERE a.tier = 'XXL' AND b.tier = 'XXL'),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
regions AS (SELECT a AS tile_id, min(b) AS region FROM reach GROUP BY a)"""


@query("L-02a_parent_regions", f"WITH RECURSIVE {X.TILES}, {BOX_SQL}, {_REG} SELECT tile_id, region FROM regions")
def parent_regions(spark, d):
    return L.parent_regions(X.tiles(spark, d))


_HELD = f"(realm IN ('{K.OOD_REALMS[0]}') OR biome_num IN (10, 14))"
HIER_SQL = f"""{X.TILES}, {BLOCK_SQL}, {FOOT_SQL}, {_STRATA}, {BOX_SQL}, {_REG},
ood AS (SELECT DISTINCT block_id AS block FROM blocked WHERE {_HELD}),
asg AS (SELECT a.block, CASE WHEN o.block IS NOT NULL THEN 'ood_region' ELSE split END AS split FROM {_assign('bs', K.SPLIT_SEED)} a LEFT JOIN ood o ON a.block = o.block),
regs AS (SELECT DISTINCT region AS block, 'all' AS stratum FROM regions),
outs AS (SELECT region, bool_or(o.block IS NOT NULL) AS out FROM regions JOIN blocked USING (tile_id) LEFT JOIN ood o ON o.block = blocked.block_id GROUP BY region),
comps AS (SELECT c.block AS region, CASE WHEN out THEN 'ood_region' ELSE split END AS split FROM {_assign('regs', K.SPLIT_SEED + 1)} c JOIN outs ON outs.region = c.block),
whole AS (SELECT region, min(lat0) AS lat0, max(lat1) AS lat1, min(lon0) AS lon0, max(lon1) AS lon1 FROM boxes JOIN regions USING (tile_id) GROUP BY region),
hits AS (SELECT a.tile_id, count(*) AS n, bool_or(a.lat0 >= b.lat0 AND a.lat1 <= b.lat1 AND a.lon0 >= b.lon0 AND a.lon1 <= b.lon1) AS inside, min(b.region) AS region FROM boxes a JOIN whole b ON {_MEET} WHERE a.tier <> 'XXL' GROUP BY a.tile_id),
foots AS (SELECT f.tile_id, min(block) AS b, min(coalesce(split, 'train')) AS s0, max(coalesce(split, 'train')) AS s1 FROM foot f JOIN tiles t USING (tile_id) LEFT JOIN asg USING (block) WHERE t.tier <> 'XXL' AND f.tile_id NOT IN (SELECT tile_id FROM hits) GROUP BY f.tile_id),
splits AS (
  SELECT tile_id, 'parent:' || region AS region, split FROM regions JOIN comps USING (region)
  UNION ALL SELECT tile_id, CASE WHEN n = 1 AND inside THEN 'parent:' || region ELSE 'straddle:parent' END, CASE WHEN n = 1 AND inside THEN split ELSE 'excluded' END FROM hits JOIN comps USING (region)
  UNION ALL SELECT tile_id, CASE WHEN s0 = s1 THEN 'cell:' || b ELSE 'straddle:cell' END, CASE WHEN s0 = s1 THEN s0 ELSE 'excluded' END FROM foots)"""


@query("L-02_hierarchical_splits", f"WITH RECURSIVE {HIER_SQL} SELECT tile_id, region, split FROM splits")
def hierarchical(spark, d):
    return L.hierarchical(X.tiles(spark, d))


@query("L-04_leakage_check", f"WITH RECURSIVE {HIER_SQL} SELECT a.tile_id AS a, b.tile_id AS b FROM boxes a JOIN splits sa ON a.tile_id = sa.tile_id JOIN boxes b ON {_MEET} JOIN splits sb ON b.tile_id = sb.tile_id WHERE sa.split IN ('train', 'val') AND sb.split NOT IN ('train', 'val', 'excluded')")
def leakage(spark, d):
    t = X.tiles(spark, d)
    return L.leaks(t.join(L.hierarchical(t).select("tile_id", "split"), "tile_id"))


@query("J-10_leaking_pairs", f"WITH {X.TILES}, {BOX_SQL} SELECT a.tile_id AS a, b.tile_id AS b FROM boxes a JOIN boxes b ON {_MEET} WHERE a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1")
def leaking(spark, d):
    t = X.tiles(spark, d).withColumn("split", F.when(F.col("c_custkey") % 2 == 0, "train").otherwise("test_id"))
    return L.leaks(t)


@query("A-24_split_counts", f"WITH RECURSIVE {HIER_SQL} SELECT tier, {', '.join(f'''count(*) FILTER (split = '{s}') AS {s}''' for s in ('train', 'val', 'test_id', 'ood_region', 'excluded'))} FROM splits JOIN tiles USING (tile_id) GROUP BY tier")
def split_counts(spark, d):
    t = X.tiles(spark, d)
    s = L.hierarchical(t).join(t.select("tile_id", "tier"), "tile_id")
    return s.groupBy("tier").pivot("split", ["train", "val", "test_id", "ood_region", "excluded"]).count().na.fill(0)


@query("J-03_left_with_default", f"WITH RECURSIVE {HIER_SQL} SELECT t.tile_id, coalesce(s.split, 'excluded') AS split FROM tiles t LEFT JOIN (SELECT * FROM splits WHERE region LIKE 'cell:%') s USING (tile_id)")
def left_default(spark, d):
    t = X.tiles(spark, d)
    s = L.hierarchical(t).where("region LIKE 'cell:%'").select("tile_id", "split")
    return t.join(s, "tile_id", "left").select("tile_id", F.coalesce("split", F.lit("excluded")).alias("split"))


@query("J-06_tiles_by_tables", f"WITH {X.TILES} SELECT tile_id, table_id FROM tiles, (SELECT unnest({K.TABLE_NAMES}) AS table_id)")
def cross(spark, d):
    return X.tiles(spark, d).select("tile_id", F.explode(F.array(*[F.lit(n) for n in K.TABLE_NAMES])).alias("table_id"))


@query("J-05_left_anti_reserve", f"WITH {X.TILES}, {_TERC}, w AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('5|' || stratum || '|' || tile_id), tile_id) AS turn FROM strata), p AS (SELECT tile_id FROM w ORDER BY turn, sha256('5|' || stratum), stratum LIMIT 60) SELECT tile_id FROM tiles ANTI JOIN p USING (tile_id)")
def reserve(spark, d):
    s = strata(spark, d)
    return s.join(S.round_robin(s, 60, "tile_id", 5).select("tile_id"), "tile_id", "left_anti").select("tile_id")


@query("W-10_replacement", f"""WITH {X.TILES}, {_TERC}, rej AS (SELECT stratum, count(*) AS need FROM strata WHERE c_custkey % 7 = 0 GROUP BY stratum),
res AS (SELECT tile_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('9|' || tile_id), tile_id) AS k FROM strata WHERE c_custkey % 7 > 3) SELECT tile_id, stratum FROM res JOIN rej USING (stratum) WHERE k <= need""")
def replacement(spark, d):
    s = strata(spark, d)
    need = s.where("c_custkey % 7 = 0").groupBy("stratum").agg(F.count(F.lit(1)).alias("need"))
    w = Window.partitionBy("stratum").orderBy(S.shuffled(9, "tile_id"), "tile_id")
    spare = s.where("c_custkey % 7 > 3").withColumn("k", F.row_number().over(w))
    return spare.join(need, "stratum").where("k <= need").select("tile_id", "stratum")


@query("F-02_realm_filter", f"WITH {X.TILES} SELECT tile_id, realm, ghm FROM tiles WHERE realm IN ('ASIA', 'EUROPE') AND isfinite(ghm) AND biome_num NOT IN (98, 99)")
def realm_filter(spark, d):
    t = X.tiles(spark, d)
    return t.where(F.col("realm").isin("ASIA", "EUROPE") & ~F.isnan("ghm") & ~F.col("biome_num").isin(98, 99)).select("tile_id", "realm", "ghm")


@query("A-12_distinct_counts", f"WITH {X.TILES}, {_TERC} SELECT count(DISTINCT biome_num) AS biomes, count(DISTINCT realm) AS realms, count(DISTINCT stratum) AS strata FROM strata")
def distinct_counts(spark, d):
    return strata(spark, d).agg(F.countDistinct("biome_num").alias("biomes"), F.countDistinct("realm").alias("realms"), F.countDistinct("stratum").alias("strata"))


@query("SRC-07_vector_bbox", f"WITH {X.TILES}, {BOX_SQL} SELECT tile_id, realm FROM boxes WHERE lat1 >= -10 AND lat0 <= 30 AND lon1 >= 0 AND lon0 <= 60")
def vector_bbox(spark, d):
    b = L.with_boxes(X.tiles(spark, d))
    return b.where((F.col("lat1") >= -10) & (F.col("lat0") <= 30) & (F.col("lon1") >= 0) & (F.col("lon0") <= 60)).select("tile_id", "realm")


@query("SRC-15_point_sample", f"""WITH {X.TILES}, {X.CELLS}, s AS (SELECT tile_id, c_custkey // 150 AS sid, CAST(floor((lat + 55) / 4) AS BIGINT) % 32 AS r, CAST(floor((lon + 180) / 12) AS BIGINT) % 32 AS c FROM tiles), m AS (SELECT sid, max(slope) AS m FROM cells GROUP BY sid)
SELECT tile_id, round(CASE WHEN m > 1.5 THEN slope / CAST(m AS DOUBLE) ELSE slope END, 6) AS value FROM s JOIN cells USING (sid, r, c) JOIN m USING (sid)""")
def point_sample(spark, d):
    """Each tile's place looked up in its raster; percentages (a raster with values over 1.5) become shares of its maximum."""
    t = X.tiles(spark, d).select("tile_id", F.expr("c_custkey DIV 150").alias("sid"), (F.floor((F.col("lat") + 55) / 4) % 32).alias("r"), (F.floor((F.col("lon") + 180) / 12) % 32).alias("c"))
    cells = X.cells(spark, d).select("sid", "r", "c", "slope")
    top = cells.groupBy("sid").agg(F.max("slope").alias("m"))
    v = t.join(cells, ["sid", "r", "c"]).join(top, "sid")
    return v.select("tile_id", F.round(F.when(F.col("m") > 1.5, F.col("slope") / F.col("m").cast("double")).otherwise(F.col("slope")), 6).alias("value"))
