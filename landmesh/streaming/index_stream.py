"""Incremental merge of index rows: new files in, the latest state of each run out, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str = "user_id") -> DataFrame:
    """The last row of each key by start and event id, with the number of tries."""
    at = F.struct("ts", "event_id")
    return df.groupBy(key).agg(F.max_by("event_type", at).alias("state"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("tries"))


def windowed_states(spark: SparkSession, folder: str, schema, lateness: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Runs per state and window of start time, as a stream with a watermark for late files."""
    log = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", lateness)
    return log.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("seconds"))


def merge_into(spark: SparkSession, folder: str, schema, target: str, checkpoint: str):
    """Process the files that are there into batch folders under ``target``; a repeated batch replaces itself.

    Each micro-batch is written under its own number, so a restart after a lost driver
    writes the same folder again and no row counts twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    log = spark.readStream.schema(schema).parquet(folder)
    q = log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return latest(spark.read.parquet(target))
