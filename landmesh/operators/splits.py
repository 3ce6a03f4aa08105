"""Split assignment without leakage: blocks, tiles, flags, hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from .shared import ensure_checkpoints


def assign_blocks(blocks: DataFrame, seed: int, fractions: dict[str, float] = K.SPLIT_SHARE) -> DataFrame:
    """One split per block within its stratum: ``blocks`` has block and stratum, one row each.

    Blocks are ordered by a hash and cut by the fractions, train first; counts of val
    and test round half to even, so every stratum gives to every split that it can.
    """
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "stratum", "block"), 256)
    w = Window.partitionBy("stratum")
    b = blocks.withColumn("_k", F.row_number().over(w.orderBy(key, "block")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    val, test = F.bround(F.col("_n") * fractions["val"]), F.bround(F.col("_n") * fractions["test_id"])
    train = F.col("_n") - val - test
    split = F.when(F.col("_k") < train, "train").when(F.col("_k") < train + val, "val").otherwise("test_id")
    return b.select("block", "stratum", split.alias("split"))


def block_strata(tiles: DataFrame) -> DataFrame:
    """Stratum of each block that any tile touches: the commonest realm of the tiles centred there, the smallest on ties."""
    grid = G.Blocks()
    home = tiles.withColumn("block", grid.id(F.col("lat"), F.col("lon"))).groupBy("block", "realm").agg(F.count(F.lit(1)).alias("n"))
    best = home.groupBy("block").agg(F.min_by("realm", F.struct(-F.col("n"), "realm")).alias("stratum"))
    touched = grid.footprint(tiles, "tile_id").select("block").distinct()
    return touched.join(best, "block", "left").select("block", F.coalesce("stratum", F.lit("all")).alias("stratum"))


def rank(split: Column) -> Column:
    out = F.when(split == "train", 0)
    for name, n in K.SPLIT_RANK.items():
        out = out.when(split == name, n)
    return out


def footprint_rule(tiles: DataFrame, assigned: DataFrame) -> DataFrame:
    """A tile's split is the most test-like among the blocks it touches."""
    f = G.Blocks().footprint(tiles, "tile_id").join(assigned, "block", "left")
    f = f.withColumn("split", F.coalesce("split", F.lit("train")))
    return f.groupBy("tile_id").agg(F.max_by("split", rank(F.col("split"))).alias("split"))


def with_boxes(tiles: DataFrame) -> DataFrame:
    return tiles.withColumns(G.tile_box(F.col("lat"), F.col("lon"), F.col("half_m")))


def _cells(df: DataFrame, step: float) -> DataFrame:
    a = F.sequence(F.floor(F.col("lat0") / step), F.floor(F.col("lat1") / step))
    o = F.sequence(F.floor(F.col("lon0") / step), F.floor(F.col("lon1") / step))
    return df.withColumn("_i", F.explode(a)).withColumn("_j", F.explode(o))


def boxes_meet(left: DataFrame, right: DataFrame, key: str, step: float = 20.0) -> DataFrame:
    """Pairs of boxes that overlap strictly: columns a and b.

    Both sides are dealt to cells of ``step`` degrees, joined by cell and checked; a
    pair counts in the cell of its overlap's corner alone, so no distinct is needed
    and no nested loop runs.
    """
    cols = ["lat0", "lat1", "lon0", "lon1"]
    a = _cells(left.select(F.col(key).alias("a"), *[F.col(c).alias(c) for c in cols]), step).withColumnsRenamed({c: f"a_{c}" for c in cols})
    b = _cells(right.select(F.col(key).alias("b"), *[F.col(c).alias(c) for c in cols]), step)
    j = a.join(b, ["_i", "_j"])
    meet = (F.col("a_lat1") > F.col("lat0")) & (F.col("lat1") > F.col("a_lat0")) & (F.col("a_lon1") > F.col("lon0")) & (F.col("lon1") > F.col("a_lon0"))
    corner = (F.col("_i") == F.floor(F.greatest("a_lat0", "lat0") / step)) & (F.col("_j") == F.floor(F.greatest("a_lon0", "lon0") / step))
    inside = (F.col("a_lat0") >= F.col("lat0")) & (F.col("a_lat1") <= F.col("lat1")) & (F.col("a_lon0") >= F.col("lon0")) & (F.col("a_lon1") <= F.col("lon1"))
    return j.where(meet & corner).select("a", "b", inside.alias("inside"))


def parent_regions(tiles: DataFrame, parent: str = "XXL") -> DataFrame:
    """Parents whose boxes overlap form one region, named by its smallest tile: tile_id, region.

    The region of a parent is the least name it can reach; the labels of overlapping
    parents are lowered until none changes.
    """
    p = with_boxes(tiles.where(F.col("tier") == parent))
    links = boxes_meet(p, p, "tile_id").where("a <> b").select("a", "b")
    return labels(p.select(F.col("tile_id").alias("v")), links)


def labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable name of every node (v) over symmetric links (a, b): tile_id and region."""
    ensure_checkpoints(nodes.sparkSession)
    state = nodes.withColumn("region", F.col("v"))
    while True:
        near = links.join(state, links.a == state.v).groupBy("b").agg(F.min("region").alias("m"))
        new = state.join(near, state.v == near.b, "left").select("v", F.least("region", F.coalesce("m", "region")).alias("region"), F.col("region").alias("_old"))
        new = new.checkpoint()
        if new.where("region <> _old").isEmpty():
            return new.select(F.col("v").alias("tile_id"), "region")
        state = new.select("v", "region")


def hierarchical(tiles: DataFrame, seed: int = K.SPLIT_SEED, held: Column | None = None, parent: str = "XXL") -> DataFrame:
    """Splits of tiles of all tiers: tile_id, region and split.

    Parents are regions of their own. Any other tile takes the split of the one parent
    region that holds it, is excluded if it straddles one, and else takes the common
    split of the blocks it touches, or is excluded if they differ.
    """
    grid = G.Blocks()
    held = F.col("realm").isin(K.OOD_REALMS) | F.col("biome_num").isin(K.OOD_BIOMES) if held is None else held
    home = tiles.withColumn("block", grid.id(F.col("lat"), F.col("lon"))).withColumn("_held", held)
    ood = home.where("_held").select("block").distinct().withColumn("_ood", F.lit(True))
    blocks = assign_blocks(block_strata(tiles), seed).join(ood, "block", "left")
    blocks = blocks.select("block", F.when(F.col("_ood"), "ood_region").otherwise(F.col("split")).alias("split"))

    region = parent_regions(tiles, parent)
    comps = assign_blocks(region.select(F.col("region").alias("block")).distinct().withColumn("stratum", F.lit("all")), seed + 1)
    centre = region.join(home.select("tile_id", "block"), "tile_id").join(ood, "block", "left").groupBy("region").agg(F.coalesce(F.bool_or("_ood"), F.lit(False)).alias("_out"))
    comps = comps.join(centre, comps.block == centre.region).select("region", F.when(F.col("_out"), "ood_region").otherwise(F.col("split")).alias("split"))
    parents = region.join(comps, "region").select("tile_id", F.concat(F.lit("parent:"), "region").alias("region"), "split")

    boxed = with_boxes(tiles)
    whole = boxed.join(region, "tile_id").groupBy("region").agg(F.min("lat0").alias("lat0"), F.max("lat1").alias("lat1"), F.min("lon0").alias("lon0"), F.max("lon1").alias("lon1"))
    rest = boxed.where(F.col("tier") != parent)
    hits = boxes_meet(rest.withColumnRenamed("tile_id", "k"), whole.withColumnRenamed("region", "k"), "k")
    hits = hits.groupBy(F.col("a").alias("tile_id")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("inside").alias("inside"), F.min("b").alias("region"))
    hits = hits.join(comps, "region")
    one = (F.col("n") == 1) & F.col("inside")
    near = hits.select("tile_id", F.when(one, F.concat(F.lit("parent:"), "region")).otherwise(F.lit("straddle:parent")).alias("region"), F.when(one, F.col("split")).otherwise(F.lit("excluded")).alias("split"))

    far = rest.join(near.select("tile_id"), "tile_id", "left_anti")
    foot = grid.footprint(far, "tile_id").join(blocks, "block", "left").withColumn("split", F.coalesce("split", F.lit("train")))
    foot = foot.groupBy("tile_id").agg(F.min("block").alias("b"), F.min("split").alias("s0"), F.max("split").alias("s1"))
    same = F.col("s0") == F.col("s1")
    far = foot.select("tile_id", F.when(same, F.concat(F.lit("cell:"), "b")).otherwise(F.lit("straddle:cell")).alias("region"), F.when(same, F.col("s0")).otherwise(F.lit("excluded")).alias("split"))
    return parents.unionByName(near).unionByName(far)


def ood_flags() -> dict[str, Column]:
    """Membership in the held-out sets, from split, tier, family, resistance_table_id and contrast."""
    real = F.col("family") == "real"
    return {
        "test_ood_region": F.col("split") == "ood_region",
        "test_ood_scale": F.col("tier").isin("XL", "XXL") & ~F.col("split").isin("train", "val"),
        "test_ood_table": real & (F.col("resistance_table_id") == K.OOD_TABLE),
        "test_ood_contrast": (F.col("family") == "synthetic") & (F.coalesce(F.col("contrast"), F.lit(0)) >= K.OOD_CONTRAST),
        "test_ood_synth2real": real & (F.col("split") == "test_id"),
    }


def held_out(split: Column, table: Column, contrast: Column) -> Column:
    """Training rows of a held-out table or contrast become test rows."""
    return F.when(split.isin("train", "val") & (table | contrast), "test_ood").otherwise(split)


def final_split(df: DataFrame, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Hold-outs, then the shares of the large tiers by a stable hash, then all flags on the final split."""
    flags = ood_flags()
    df = df.withColumn("split", held_out(F.col("split"), flags["test_ood_table"], flags["test_ood_contrast"]))
    trained = F.col("split").isin("train", "val")
    key = F.coalesce("block_id", F.col("sample_id").cast("string"))
    share = G.hash_share(F.lit(str(seed)), F.lit("xl"), key)
    demoted = trained & ((F.col("tier") == "XXL") | ((F.col("tier") == "XL") & (share >= K.XL_SHARE)))
    df = df.withColumn("split", F.when(demoted, "test_id").otherwise(F.col("split")))
    return df.withColumns(ood_flags())


def leaks(tiles: DataFrame) -> DataFrame:
    """Pairs of a training tile and a test tile whose boxes overlap; there must be none."""
    b = with_boxes(tiles)
    return boxes_meet(b.where(F.col("split").isin("train", "val")), b.where(~F.col("split").isin("train", "val", "excluded")), "tile_id").select("a", "b")
