"""The index of solved samples: quality, splits, routing, analytics, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def mapped(values: dict, key: Column) -> Column:
    """A small fixed map as a column lookup."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def flag_list(text: Column) -> Column:
    """Comma-joined flags as an array; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def quality_pass(flags: Column) -> tuple[Column, Column]:
    """Good for the index, and good for training, by an array of flags."""
    soft = F.array(*[F.lit(x) for x in (*K.INFO_FLAGS, *K.TRAINING_FLAGS)])
    ok = F.size(F.array_except(flags, soft)) == 0
    return ok, ok & ~F.arrays_overlap(flags, F.array(*[F.lit(x) for x in K.TRAINING_FLAGS]))


def solver_flags(converged: Column, fallback: Column, finite: Column, zero: Column, residual: Column, *more: tuple[Column, str]) -> Column:
    """Flags of one solve; conditions that are null raise none."""
    rules = [(~converged, "not_converged"), (fallback, "fallback_solver"), (~finite, "nonfinite_output"), (zero, "all_zero_output"), (converged & (residual > 1e-6), "residual_high"), *more]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def timing(df: DataFrame) -> DataFrame:
    t = "solve_time_s"
    return df.groupBy("tier", "task", "solver").agg(F.count(t).alias("n"), F.median(t).alias("t_median"), F.percentile(t, F.lit(0.9)).alias("t_p90"), F.max(t).alias("t_max"), F.avg(t).alias("t_mean"), F.max("maxrss_mb").alias("rss_max_mb"))


def power_law(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """a and b of y = a * x ** b by least squares on logarithms; one point has slope 1."""
    lx, ly = F.log(x), F.log(y)
    g = df.groupBy(*keys).agg(F.countDistinct(x).alias("_n"), F.regr_slope(ly, lx).alias("_b"), F.regr_intercept(ly, lx).alias("_a"), F.avg(lx).alias("_x"), F.avg(ly).alias("_y"))
    b = F.when(F.col("_n") > 1, F.col("_b")).otherwise(F.lit(1.0))
    a = F.when(F.col("_n") > 1, F.col("_a")).otherwise(F.col("_y") - F.col("_x"))
    return g.select(*keys, F.exp(a).alias("a"), b.alias("b"))


def landscapes(spark, ladder: dict[str, int] = K.LADDER, synthetic: float = 0.6) -> DataFrame:
    """Planned landscapes per tier, family, stratum and table."""
    tiers = spark.createDataFrame(list(ladder.items()), "tier string, n int")
    strata = [(k, v) for k, v in K.GENERATOR_MIX.items() if k != "hard"] + [(f"hard:{k}", K.GENERATOR_MIX["hard"] * v) for k, v in K.HARD_MIX.items()]
    n_syn = F.bround(F.col("n") * synthetic)
    tiles = F.ceil((F.col("n") - n_syn) / len(K.TABLE_NAMES))
    syn = [F.struct(F.lit("synthetic").alias("family"), F.lit(s).alias("stratum"), F.lit("-").alias("table"), F.bround(F.round(n_syn * f, 6)).cast("bigint").alias("landscapes")) for s, f in strata]
    real = [F.struct(F.lit("real").alias("family"), F.lit("tile x table").alias("stratum"), F.lit(t).alias("table"), tiles.cast("bigint").alias("landscapes")) for t in K.TABLE_NAMES]
    return tiers.select("tier", F.inline(F.array(*syn, *real)))


def solves(land: DataFrame) -> DataFrame:
    """Planned solves per tier, family and configuration."""
    n = land.groupBy("tier", "family").agg(F.sum("landscapes").alias("n"))
    one = [F.struct(F.lit(c).alias("config"), F.bround(F.round(F.col("n") * p, 6)).cast("bigint").alias("solves")) for c, p in K.PER_LANDSCAPE.items()]
    return n.select("tier", "family", F.inline(F.array(*one))).where("NOT (config = 'regions' AND family = 'synthetic')")


def solve_seconds(config: Column, tier: Column) -> Column:
    """Measured seconds of a configuration and tier, else the smallest tier's scaled by pixels."""
    kind = mapped(K.KIND_OF, config)
    key = F.concat_ws("|", kind, tier)
    known = mapped({f"{k}|{t}": float(s) for k, by in K.COST_SECONDS.items() for t, s in by.items()}, key)
    small = mapped({k: float(by["S"]) for k, by in K.COST_SECONDS.items()}, kind)
    pixels = mapped({t: float(s * s) for t, s in K.TIER_SIZE.items()}, tier)
    return F.coalesce(known, small * pixels / float(K.TIER_SIZE["S"] ** 2))


def cost(land: DataFrame) -> DataFrame:
    """Hours and storage per tier, with a total row."""
    sec = solves(land).groupBy("tier").agg(F.sum(solve_seconds(F.col("config"), F.col("tier")) * F.col("solves")).alias("sec"))
    mb = mapped({f"{f}|{t}": float(v) for f, by in K.STORAGE_MB.items() for t, v in by.items()}, F.concat_ws("|", "family", "tier"))
    size = land.groupBy("tier").agg(F.sum("landscapes").alias("landscapes"), (F.sum(F.col("landscapes") * mb) / 1000).alias("gb"))
    t = sec.join(size, "tier").select("tier", "landscapes", F.round(F.col("sec") * (1 + K.OVERHEAD) / 3600, 0).alias("cpu_hours"), F.round("gb", 1).alias("storage_gb"))
    return t.rollup("tier").agg(F.sum("landscapes").alias("landscapes"), F.sum("cpu_hours").alias("cpu_hours"), F.round(F.sum("storage_gb"), 1).alias("storage_gb")).select(F.coalesce("tier", F.lit("total")).alias("tier"), "landscapes", "cpu_hours", "storage_gb")


def structural_similarity(pairs: DataFrame, x: str, y: str, reach: int = 1, span: float = 1.0) -> DataFrame:
    """Mean structural similarity of two rasters (sid, r, c, x, y) over windows of ``2 * reach + 1`` cells a side.

    Window sums of the values, their squares and products go along rows, then along
    columns; at the border a window has fewer cells.
    """
    sums = {"_x": F.col(x), "_y": F.col(y), "_xx": F.col(x) * F.col(x), "_yy": F.col(y) * F.col(y), "_xy": F.col(x) * F.col(y), "_n": F.lit(1)}
    across = Window.partitionBy("sid", "r").orderBy("c").rowsBetween(-reach, reach)
    along = Window.partitionBy("sid", "c").orderBy("r").rowsBetween(-reach, reach)
    p = pairs.withColumns(sums)
    p = p.select("sid", "r", "c", *[F.sum(k).over(across).alias(k) for k in sums])
    p = p.select("sid", *[F.sum(k).over(along).alias(k) for k in sums])
    mx, my, xx, yy, xy = (F.col(k) / F.col("_n") for k in ("_x", "_y", "_xx", "_yy", "_xy"))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * mx * my + c1) * (2 * (xy - mx * my) + c2) / ((mx * mx + my * my + c1) * (xx - mx * mx + yy - my * my + c2))
    return p.groupBy("sid").agg(F.avg(s).alias("ssim"))
