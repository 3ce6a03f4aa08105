"""Row numbers within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def ranked(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """Add ``name``: the row's number from 0 within ``group`` in the order of ``order``.

    The rows are range-sorted by group and order, so a group of any size spreads
    over many partitions. Written once, each row keeps its place in its partition;
    a row's number is that place plus what earlier partitions hold of its group.
    Rows that are equal in group and order are numbered in any order.
    """
    keys = [F.col(c).asc_nulls_last() for c in group] + list(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, name)
    low = F.lit((1 << 33) - 1)
    placed = placed.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low))
    parts = placed.groupBy("_pid", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    parts = parts.select(F.col("_pid").alias("_p"), "_shift", *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)])
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(parts, same).withColumn(name, F.col("_at") + F.col("_shift"))
    return joined.drop("_at", "_pid", "_p", "_shift", *[f"_g{i}" for i in range(len(group))])
