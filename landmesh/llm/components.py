"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` has long columns a and b. Returns v and component, the smallest reachable vertex.

    Large-star and small-star rounds alternate until nothing changes: each joins a
    vertex's neighbours to the smallest of them, so the number of rounds follows the
    logarithm of the longest path. Minima are partly aggregated before the shuffle. The
    edges of a hub meet its one minimum in a join whose other side has a row a vertex;
    adaptive execution splits that partition, and no task collects a neighbourhood.
    Each round's tables are deleted once the next ones are written.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u hangs on the smallest vertex around u.
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large, last = materialize(large, name), e
        # Small star: u and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(least, F.col("u") == F.col("_u"))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        e = materialize(small, name)
        release(large, last)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = e.select(F.col("v").alias("u"), "v")
    return e.unionByName(roots).groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("v"), "component")
