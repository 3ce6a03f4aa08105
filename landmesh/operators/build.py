"""A build from plan to index: each step reads the last one's folder and skips what is done.

Folders below ``root``: manifest, inputs, outputs and index, all Parquet by shard. A step
appends only shards that lack, so a run that was cut short goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import solve as S

STEPS = ("manifest", "inputs", "outputs", "index")


def plan(seeds: DataFrame, root: str, shard_size: int = 50) -> None:
    """The manifest: one sample a seed, ``shard_size`` seeds a shard. A manifest that is there stays."""
    if not _there(seeds.sparkSession, f"{root}/manifest"):
        seeds.select("seed", F.floor(F.col("seed") / shard_size).alias("shard")).write.partitionBy("shard").parquet(f"{root}/manifest")


def prepare(spark: SparkSession, root: str, side: int = 16, focal: int = 3) -> int:
    """Landscapes and focal points of the shards that have no inputs; returns how many samples."""
    todo = _lacking(spark, root, "manifest", "inputs")

    def made(t: DataFrame) -> DataFrame:
        cells = S.landscapes(t, side)
        points = S.focal_points(cells, focal, 3).select("sid", "r", "c", F.col("label").alias("focal"))
        cells = cells.join(points, ["sid", "r", "c"], "left").na.fill(0, ["focal"])
        return cells.join(t.select(F.col("seed").alias("sid"), "shard"), "sid")

    return _append(todo, made, f"{root}/inputs")


def solve(spark: SparkSession, root: str) -> int:
    """Effective resistances of the shards that have inputs but no outputs; returns how many samples."""
    todo = _lacking(spark, root, "inputs", "outputs")

    def made(t: DataFrame) -> DataFrame:
        return S.pairwise(t).join(t.select("sid", "shard").distinct(), "sid")

    return _append(todo, made, f"{root}/outputs", "sid")


def finalize(spark: SparkSession, root: str, most: float = 1e-6) -> int:
    """One index row a sample of the shards that have outputs: pairs, worst residual and flags; returns how many."""
    todo = _lacking(spark, root, "outputs", "index")

    def made(t: DataFrame) -> DataFrame:
        g = t.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("residual").alias("residual"), F.bool_or("fallback_used").alias("fallback"), F.min("reff").alias("_least"))
        flags = F.array_compact(F.array(F.when(F.col("residual") > most, F.lit("residual_high")), F.when(F.col("fallback"), F.lit("fallback_solver")), F.when(F.col("_least") < 0, F.lit("isolated_focal"))))
        return g.withColumn("qc_flags", F.array_join(flags, ",")).drop("_least")

    return _append(todo, made, f"{root}/index", "sid")


def status(spark: SparkSession, root: str) -> DataFrame:
    """Samples of each shard at each step."""
    out = None
    for step in STEPS:
        if _there(spark, f"{root}/{step}"):
            key = "seed" if step == "manifest" else "sid"
            part = spark.read.parquet(f"{root}/{step}").groupBy("shard").agg(F.countDistinct(key).alias(step))
        else:
            part = spark.createDataFrame([], f"shard bigint, {step} bigint")
        out = part if out is None else out.join(part, "shard", "left")
    return out.na.fill(0, list(STEPS))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _lacking(spark: SparkSession, root: str, have: str, want: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{have}")
    if not _there(spark, f"{root}/{want}"):
        return rows
    return rows.join(spark.read.parquet(f"{root}/{want}").select("shard").distinct(), "shard", "left_anti")


def _append(todo: DataFrame, made, path: str, key: str = "seed") -> int:
    n = todo.select(key).distinct().count()
    if n:
        made(todo).write.mode("append").partitionBy("shard").parquet(path)
    return n
