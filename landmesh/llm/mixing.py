"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size``: the text's words (null: 0)."""
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))
    return docs.withColumn("size", words.cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: ``sizes`` has source and source_size, one row each.

    Sources in code-point order, null last, take the weights in turn and divide
    ``share`` times the sum of all sizes; none gets more than ``most`` times its own
    size, and what is over goes to the others by weight. That is the level L at which
    the sum of least(most * size, weight * L) reaches the total: with sources sorted by
    most * size / weight, those before some place are capped and L follows from the rest.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", w)
    s = s.withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_lim", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_lim", "_no")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_open", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    total = F.lit(share) * F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_level", (total - F.col("_capped")) / F.col("_open"))
    # The first source that the level does not cap fixes it for all after it.
    everyone = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("_level") <= F.col("_lim"), F.col("_level")), ignorenulls=True).over(everyone)
    s = s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap"))))
    return s.select("source", "source_size", "target")


def offset(source: str, seed: int):
    """One number in [0, 1) for each source, from the seed and the source's name."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Copies of each document so that sources come near their targets.

    A document's expected copies are its source's target over its size, the same for
    all its documents. Within a source documents stand in the order of size and id;
    the sum of expected copies up to a document, plus the source's one offset, crosses
    a number of integer boundaries at the document: those are its copies, at most
    ``most`` rounded up. Sorting by size keeps the taken words within about one large
    document of the target. Needs doc_id, source and text; other columns are ignored.
    Returns doc_id, size, source_size, target, copies and taken. A null source is a
    source of its own, sources of no words have target 0, repeated rows count apart.
    """
    few = materialize(sized(docs).select("doc_id", "source", "size"), "sizes")
    goal = targets(few.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    placed = ranked(few, ["source"], [F.col("size"), F.col("doc_id")], "_rank")
    goal = goal.withColumnRenamed("source", "_s").withColumn("_u", offset("_s", seed))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = placed.join(goal, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_e", rate)
    crossed = F.floor(F.col("_u") + F.col("_e") * (F.col("_rank") + 1)) - F.floor(F.col("_u") + F.col("_e") * F.col("_rank"))
    both = both.withColumn("copies", crossed.cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says, all columns as they are.

    Rows that agree in id, source and size divide their copies evenly, those of the
    smallest hash of their texts first; only rows that are equal in all of these may
    stand for one another. An empty table gives an empty result.
    """
    keys = ["doc_id", "source", "size"]
    copies = mix(docs, **how).groupBy(*keys).agg(F.sum("copies").alias("__lm_c"), F.count(F.lit(1)).alias("__lm_m"))
    copies = copies.withColumnsRenamed({k: f"__lm_{k}" for k in keys})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__lm_row")
    rows = sized(docs.select(row, "doc_id", "source", "text")).withColumn("__lm_tie", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__lm_{k}"))
    rows = rows.join(copies.where(F.col("__lm_c") > 0), same)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__lm_tie"))
    each = F.floor(F.col("__lm_c") / F.col("__lm_m")) + (F.col("__lm_no") <= F.col("__lm_c") % F.col("__lm_m")).cast("int")
    rows = rows.withColumn("__lm_no", number).withColumn("__lm_k", each.cast("int")).where(F.col("__lm_k") > 0)
    return rows.select("__lm_row", F.explode(F.sequence(F.lit(1), F.col("__lm_k")))).select("__lm_row.*")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, ([5.0, 2.0, 1.0])[(no - 1) % 3 + 1]::DOUBLE AS w FROM s
), c AS (
  SELECT *, cap / w AS lim FROM w
), o AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY lim, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY lim, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), l AS (
  SELECT first(level ORDER BY lim, no) AS level FROM o WHERE level <= lim
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * level, cap)) AS target,
    CAST(('0x' || substr(sha256('7|' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM c LEFT JOIN l ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(u + e * k) - floor(u + e * (k - 1)) AS BIGINT) * size AS taken FROM r
"""
