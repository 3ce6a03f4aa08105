"""Stratified sampling of tiles in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tercile(value: Column, low: Column, high: Column) -> Column:
    """0, 1 or 2 by two edges; -1 for no value."""
    return F.when(value.isNull() | F.isnan(value), -1).when(value <= low, 0).when(value <= high, 1).otherwise(2)


def with_terciles(df: DataFrame, value: str) -> DataFrame:
    """Add the tercile of ``value`` by the exact linear quantiles of its valid rows."""
    edges = df.where(~F.isnan(value)).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_e"))
    out = df.crossJoin(F.broadcast(edges))  # one row
    return out.withColumn("tercile", tercile(F.col(value), F.get("_e", F.lit(0)), F.get("_e", F.lit(1)))).drop("_e")


def stratum() -> Column:
    return F.format_string("B%02d|%s|H%d", F.col("biome_num"), F.col("realm"), F.col("tercile"))


def shuffled(seed: int, *keys: str) -> Column:
    """A fixed random order of rows."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256)


def round_robin(df: DataFrame, n: int, key: str, seed: int, cap: int | None = None) -> DataFrame:
    """``n`` rows, one of each stratum per round, so counts per stratum differ by at most one where they can.

    Strata and rows within them stand in hash order. A sort-limit takes the first n
    by round, so no task holds all rows.
    """
    w = Window.partitionBy("stratum").orderBy(shuffled(seed, "stratum", key), key)
    rows = df.where(F.col("tercile") >= 0).withColumn("turn", F.row_number().over(w))
    if cap:
        rows = rows.where(F.col("turn") <= cap)
    return rows.orderBy("turn", shuffled(seed, "stratum"), "stratum").limit(n)
