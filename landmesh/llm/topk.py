"""Exact top-k search by inner product."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_whole, write_whole
from .store import materialize, new_path

#: Vectors in a tile of candidates and of queries, and candidate tiles that one task meets a query tile with.
TILE, QUERY_TILE, SHARD = 4096, 1024, 16
#: Branches of the merge tree below its root.
BRANCHES = 16


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & ~bad)


def quantized(df: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """``floor(scale * x)`` of every component, x as double."""
    return df.withColumn(vector, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def top_of_tile(queries: np.ndarray, q_ids: np.ndarray, tile: np.ndarray, ids: np.ndarray, k: int):
    """The k best of one tile for each query: (query row, id, score); ids ascend in the tile.

    Score and place make one integer key, so ties go to the smaller id and a
    partial selection never sees equal keys.
    """
    m = len(ids)
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
    if bound >= 2**63:
        exact = np.where(ids[None, :] == q_ids[:, None], 0, queries.astype(object) @ tile.astype(object).T)
        if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 2**63:
            raise OverflowError("a score needs more than 64 bits")
        score = exact.astype(np.int64)
    elif bound < 2**52:
        score = (queries.astype(np.float64) @ tile.astype(np.float64).T).astype(np.int64)
    else:
        score = queries @ tile.T
    if bound * m < 2**62:
        key = score * m + (m - 1 - np.arange(m))
        key = np.where(ids[None, :] == q_ids[:, None], np.iinfo(np.int64).min, key)
        take = min(k + 1, m)
        at = np.argpartition(key, m - take, axis=1)[:, m - take :]
    else:
        at = np.stack([np.lexsort((ids, ~row))[: k + 1] for row in score])
    rows = np.repeat(np.arange(len(q_ids)), at.shape[1])
    at = at.ravel()
    other = ids[at] != q_ids[rows]
    rows, at = rows[other], at[other]
    return rows, ids[at], score[rows, at]


def best(rows, ids, scores, k: int):
    """The k best of each query row, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    keep = place < k
    return rows[keep], ids[keep], scores[keep]


def write_tiles(vectors: DataFrame, folder: str, size: int) -> DataFrame:
    """Vectors (id, v) as files of up to ``size`` of one length, in the order of ids; returns path, d and n of each.

    Numbers are kept in the smallest type that holds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, done = TaskContext.get().partitionId(), {}, []

        def close(d: int) -> None:
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")
            top = int(np.abs(vecs).max(initial=0))
            kind = next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
            out = io.BytesIO()
            np.savez(out, ids=ids[order], v=vecs[order].astype(kind))
            done.append((write_whole(folder, f"tile-{part:06d}-{len(done):06d}.npz", out.getvalue()), d, len(ids)))

        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch["v"]))
            ids = batch["id"].to_numpy()
            for d in np.unique(sizes):
                of = np.flatnonzero(sizes == d)
                vecs = batch["v"].take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), d)
                for lo in range(0, len(of), size):
                    some = held.setdefault(int(d), [])
                    some.append((ids[of[lo : lo + size]], vecs[lo : lo + size]))
                    if sum(len(x[0]) for x in some) >= size:
                        close(int(d))
        for d in list(held):
            close(d)
        cols = list(zip(*done, strict=True)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["path", "d", "n"])

    return materialize(vectors.select("id", "v").mapInArrow(run, "path string, d int, n int"), "tiles")


def _tile(path: str) -> tuple[np.ndarray, np.ndarray]:
    with open_whole(path) as (f, _):
        got = np.load(io.BytesIO(f.read()))
    return got["ids"], got["v"].astype(np.int64)


def search(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k candidates of largest integer inner product.

    Queries and candidates have ``id_col`` (long) and ``vector`` (array<bigint>). Both are
    written once as tiles in the shared folder. A task multiplies one query tile with a
    shard of up to ``SHARD`` candidate tiles, keeps the k best of each tile and merges
    them; lists then merge by branch and by query. Nothing is broadcast or sent to the
    driver, and a task holds two tiles and k candidates a query.
    A candidate with the query's own id is left out, ties go to the smaller id, and
    vectors of another length than the query's are no candidates. Null ids take no part.
    Repeated candidate rows count as often as they occur; of several query rows of one
    id the smallest vector counts. Scores that 64 bits can't hold raise OverflowError.
    No queries or no candidates give no rows. Returns query_id, rank (from 1), vec_id and
    score.
    """
    spark = queries.sparkSession
    known = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col(vector).isNotNull())
    asked = known(queries).groupBy("id").agg(F.min("v").alias("v"))
    c = write_tiles(known(candidates), new_path(spark, "candidates"), TILE)
    q = write_tiles(asked, new_path(spark, "queries"), QUERY_TILE).select(F.col("path").alias("q"), "d")
    tiles = c.count()
    shards = c.groupBy("d", F.pmod(F.xxhash64("path"), F.lit(max(1, tiles // SHARD))).alias("shard")).agg(F.collect_list("path").alias("tiles"))
    grid = q.join(shards, "d").select("q", "tiles", F.pmod("shard", F.lit(BRANCHES)).cast("int").alias("branch"))
    grid = grid.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, paths, branch in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                q_ids, vecs = _tile(path)
                lists = None
                for at in sorted(paths):
                    ids, tile = _tile(at)
                    new = top_of_tile(vecs, q_ids, tile, ids, k)
                    lists = best(*(new if lists is None else (np.concatenate(x) for x in zip(lists, new, strict=True))), k)
                rows, ids, scores = lists
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids), pa.array(scores), pa.array(np.full(len(ids), branch, np.int32))], names=["query_id", "vec_id", "score", "branch"])

    found = materialize(grid.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, branch int"), "lists")
    within = Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "vec_id")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).drop("rank", "branch")
    merged = merged.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    rows = quantized(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding"), "embedding")
    return search(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


SQL = """
WITH e AS (
  SELECT vec_id, CAST([floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS DOUBLE[]) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
