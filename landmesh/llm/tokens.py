"""Encoding texts with a public tokenizer, and the exact length histogram."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Entries of a worker's cache of encoded words; it is emptied when full.
CACHE = 100_000


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Place of a public vocabulary; resolved where it is used, so workers find their own copy."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


class Encoder:
    """Byte-level BPE with the ids of the ``tokenizers`` file at ``path``.

    The split pattern never joins what stands on either side of a single space
    between two other characters, and such a space belongs to what follows it.
    A text is therefore the chain of its space-separated words, each encoded once
    and then looked up. Texts in which a space touches other white space are
    encoded whole. Strings of the file's added tokens get their ids wherever they stand,
    and what lies between them is encoded by itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        ranks = {k: v for k, v in ranks.items() if k not in {t.encode() for t in self.added}}
        self.bpe = tiktoken.Encoding("landmesh", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.uint16 if max(*ranks.values(), *self.added.values(), 0) < 2**16 else np.uint32
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), self.kind).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.later) + len(words) > CACHE:
            self.later.clear()
        ask = self.bpe.encode_ordinary
        for w in words:
            self.later[w] = None if not w or w[0].isspace() or w[-1].isspace() else np.array(ask(" " + w), self.kind).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text (null: none)."""
        if not text:
            return np.zeros(0, self.kind)
        if self.cut and self.cut.search(text):
            return np.concatenate([np.array([self.added[x]], self.kind) if x in self.added else self._plain(x) for x in self.cut.split(text) if x])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return np.frombuffer(self._whole(text), self.kind)
        later = self.later
        try:
            parts = [later[w] for w in rest]
        except KeyError:
            self._learn({w for w in rest if w not in later} if len(later) < CACHE - len(rest) else set(rest))
            parts = [later[w] for w in rest]
        if None in parts:
            return np.frombuffer(self._whole(text), self.kind)
        return np.frombuffer(self._whole(head) + b"".join(parts), self.kind)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, the rest follow U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(vocabulary(name))


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per document: ``length``, its number of tokens (null or empty text: 0).

    Whole texts of any length are encoded, one after the other; repeated rows count each.
    Only ``text`` is read, so columns of any name may stand beside it. No documents give
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            lengths = np.fromiter((len(enc.encode(t.as_py())) for t in batch.column(0)), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(lengths)], names=["length"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "length bigint")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """Exact histogram of ``length`` with suffix sums; rows of null length are no documents.

    Per distinct length: n_docs, n_tokens; over it and all longer ones docs_at_least
    and tokens_at_least; and truncated_total, the tokens left if every document is
    cut at this length. Suffix sums go by blocks of ``block`` lengths: within a block
    by a window, across blocks from the blocks' sums, so no task sees all lengths.
    An empty input gives no rows.
    """
    hist = materialize(lengths.where(F.col("length").isNotNull()).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_b", F.floor(F.col("length") / block))
    sums = hist.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = sums.select("_b", F.coalesce(F.sum("_d").over(above), zero).alias("_d"), F.coalesce(F.sum("_t").over(above), zero).alias("_t"), F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    own = Window.partitionBy("_b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.join(sums, "_b").withColumn("_own", F.sum("n_tokens").over(own))
    hist = hist.withColumn("docs_at_least", F.sum("n_docs").over(own) + F.col("_d")).withColumn("tokens_at_least", F.col("_own") + F.col("_t"))
    shorter = F.col("_upto") - F.col("_own")
    return hist.select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", (shorter + F.col("length") * F.col("docs_at_least")).alias("truncated_total"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents it cuts and the tokens it leaves.

    Both are read off the suffix sums of one row, that of the smallest length over the
    limit: the documents from there on are cut, and what they lack is their tokens less
    the limit for each. A limit that no document exceeds cuts none. An empty histogram
    gives zeros.
    """
    over = [F.min(F.when(F.col("length") > m, F.struct("length", "docs_at_least", "tokens_at_least"))).alias(f"o{i}") for i, m in enumerate(limits)]
    one = hist.agg(F.max("tokens_at_least").alias("_all"), *over)
    zero = F.lit(0).cast("bigint")

    def row(i: int, m: int):
        docs, tokens = (F.coalesce(F.col(f"o{i}.{c}"), zero) for c in ("docs_at_least", "tokens_at_least"))
        return F.struct(F.lit(m).cast("bigint").alias("context"), docs.alias("docs_cut"), (F.coalesce("_all", zero) - tokens + m * docs).alias("tokens_kept"))

    return one.select(F.inline(F.array(*[row(i, m) for i, m in enumerate(limits)])))


def length_quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least the given share of documents doesn't exceed (null if there are none).

    That is the largest length that more than the rest of the documents reach, by the
    suffix sums.
    """
    total = hist.agg(F.max("docs_at_least")).first()[0] or 0
    found = [F.max(F.when(F.col("docs_at_least") > total - max(1, math.ceil(s * total)), F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    return hist.agg(*found).select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])))


def query(spark, sf_dir):
    return length_histogram(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
