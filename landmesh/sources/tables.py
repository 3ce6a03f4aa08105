"""Reading and writing builds: partitioned index tables, split lists, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_build(index: DataFrame, root: str) -> None:
    """The index by tier and task group, so that any of them reads alone."""
    index.write.mode("overwrite").partitionBy("tier", "task_group").parquet(f"{root}/index")


def write_splits(index: DataFrame, root: str) -> None:
    """Distinct sample ids of each split."""
    index.select("split", "sample_id").distinct().write.mode("overwrite").partitionBy("split").parquet(f"{root}/splits")


def read_build(spark: SparkSession, root: str, tiers: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Rows of a build; tiers and groups prune whole folders."""
    df = spark.read.parquet(f"{root}/index")
    if tiers:
        df = df.where(F.col("tier").isin(tiers))
    return df.where(F.col("task_group").isin(groups)) if groups else df


def todo(manifest: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """What a resumed job still has to do."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def append_new(rows: DataFrame, path: str, key: str = "sample_id") -> int:
    """Append the rows whose key is not in the table yet; returns how many."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    fresh = todo(rows, spark.read.parquet(path), key) if there else rows
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ESRI ASCII grids: path, r, c and value (null for the file's no-data value)."""
    lines = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = lambda n: F.regexp_extract("value", rf"(?im)^{n}\s+(\S+)", 1)
    body = F.filter(F.split(F.regexp_replace("value", r"(?im)^[a-z_]+\s+\S+\s*$", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = lines.select("path", head("nodata_value").cast("double").alias("_nd"), F.posexplode(body).alias("r", "_line"))
    cells = rows.select("path", "_nd", F.col("r").cast("bigint").alias("r"), F.posexplode(F.split(F.trim("_line"), r"\s+")).alias("c", "_v"))
    v = F.col("_v").cast("double")
    return cells.select("path", "r", F.col("c").cast("bigint").alias("c"), F.when(v.eqNullSafe(F.col("_nd")), None).otherwise(v).alias("value"))
