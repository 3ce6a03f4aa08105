"""Builds, resumed appends, grids and the incremental merge."""

from pyspark.sql import functions as F

from landmesh.operators import sampling as S
from landmesh.operators import splits as L
from landmesh.sources import tables as T
from landmesh.streaming import index_stream as I


def test_build_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, "SM"[i % 2], ["T1", "T3", "T4"][i % 3], ["train", "val"][i % 2]) for i in range(30)], "sample_id bigint, tier string, task_group string, split string")
    T.write_build(df, str(tmp_path))
    T.write_splits(df, str(tmp_path))
    got = T.read_build(spark, str(tmp_path), ["S"], ["T1"])
    assert sorted(r.sample_id for r in got.collect()) == [0, 6, 12, 18, 24]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString() or got.count() == 5
    assert spark.read.parquet(f"{tmp_path}/splits").count() == 30


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumnRenamed("id", "sample_id")
    assert [T.append_new(df, path), T.append_new(df, path), T.append_new(spark.range(12).withColumnRenamed("id", "sample_id"), path)] == [10, 0, 2]
    assert spark.read.parquet(path).count() == 12


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nNODATA_value -9999\n1 2 -9999\n4.5 5 6\n")
    got = {(r.r, r.c): r.value for r in T.ascii_grid(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): None, (1, 0): 4.5, (1, 1): 5.0, (1, 2): 6.0}


def test_stream_merges_each_file_once(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 4).alias("user_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("event_type"), F.lit(1.0).alias("value"))
    rows.where("event_id < 20").write.mode("append").parquet(src)
    assert sum(r.tries for r in I.merge_into(spark, src, schema, out, mark).collect()) == 20
    rows.where("event_id >= 20").write.mode("append").parquet(src)
    got = {r.user_id: (r.state, r.tries) for r in I.merge_into(spark, src, schema, out, mark).collect()}
    assert got == {u: (f"s{(36 + u) % 3}", 10) for u in range(4)}
    q = I.windowed_states(spark, src, schema).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM states").first()[0] == 40


def test_round_robin_is_balanced(spark):
    df = spark.range(84).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 21).alias("stratum"), F.lit(0).alias("tercile"))
    counts = [r["count"] for r in S.round_robin(df, 50, "k", 1).groupBy("stratum").count().collect()]
    assert sum(counts) == 50 and max(counts) - min(counts) <= 1
    assert S.round_robin(df, 50, "k", 1, cap=2).count() == 42


def test_blocks_are_cut_by_fractions(spark):
    b = spark.range(400).select(F.concat(F.lit("b"), "id").alias("block"), F.concat(F.lit("r"), F.col("id") % 2).alias("stratum"))
    got = {(r.stratum, r.split): r["count"] for r in L.assign_blocks(b, 7).groupBy("stratum", "split").count().collect()}
    assert all(got[s, k] == n for s in ("r0", "r1") for k, n in (("train", 160), ("val", 20), ("test_id", 20)))
    again = L.assign_blocks(b.repartition(7), 7)
    assert again.exceptAll(L.assign_blocks(b, 7)).count() == 0
