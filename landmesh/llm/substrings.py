"""Removal of word windows that stand elsewhere in the corpus before."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .words import buffers, gives_back, window_hashes, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0d]+")

class _Windows:
    """The windows of one chunk, in the order of documents and places.

    ``hashes`` holds one or two independent 64-bit hashes of each distinct window, sorted
    by the first; ``first`` its first window, ``place`` the number of each window's hash.
    """

    def __init__(self, table: pa.Table, size: int, ways: int):
        self.rows = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), (X.TIE, "ascending")]))
        words, self.n_words = word_hashes(*buffers(self.rows["text"]), ways=ways)
        hashes, self.starts, self.n = window_hashes(words, self.n_words, size)
        order = np.argsort(hashes[0])
        if ways > 1:
            h, g = (x[order] for x in hashes)
            if ((h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():
                order = np.lexsort((hashes[1], hashes[0]))
        fresh = np.ones(len(order), bool)
        if len(order):
            fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in hashes], axis=0)
        runs = np.flatnonzero(fresh)
        self.first = np.minimum.reduceat(order, runs) if len(order) else order
        self.hashes = [x[self.first] for x in hashes]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(fresh) - 1

    def short(self, p: X.Plan) -> tuple[np.ndarray, np.ndarray]:
        """The distinct short hashes, sorted, and the number of each distinct window's."""
        return np.unique(X.short(self.hashes[0], p), return_inverse=True)

    def suspects(self, p: X.Plan, answers: list[dict]) -> np.ndarray:
        """The distinct windows whose short hash other chunks hold too."""
        values, of = self.short(p)
        return np.flatnonzero(X.told(answers, X.cells(values, p.buckets, p.bits))[of])


def _of(marks: pa.Table, turn: int) -> list[dict]:
    return [r for r in marks.to_pylist() if r["round"] == turn]


class _Shared(X.Facts):
    """First exchange, of short hashes: 1 for those that another chunk sent too."""

    def judge(self, hashes, arrays):
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        out = np.zeros(len(hashes), np.uint64)
        out[order] = np.r_[same, False] | np.r_[False, same]
        return out


class _Later(X.Facts):
    """Second exchange, of whole hashes: 1 for windows that an earlier document of another chunk holds.

    With each goes its other hash and the first document of the chunk that holds it:
    whether that lacks an id, the id, and the tie. Each document is packed once.
    """

    FIELDS = ("others", "n_docs", "none", "ids", "ties", "ranks")

    def pack(self, arrays):
        other, *doc = arrays
        order = np.lexsort(doc[::-1])
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in doc], axis=0)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(fresh) - 1
        held = [x[order][fresh] for x in doc]
        return (X.squeeze(other), int(fresh.sum()).to_bytes(8, "little"), *map(X.squeeze, held), X.squeeze(rank))

    def unpack(self, row):
        n = int.from_bytes(row["n_docs"], "little")
        rank = X.unsqueeze(row["ranks"], row["n"]).astype(np.int64)
        return [X.unsqueeze(row["others"], row["n"]), *(X.unsqueeze(row[c], n)[rank] for c in ("none", "ids", "ties"))]

    def judge(self, hashes, arrays):
        other, *doc = arrays[0], *(x.view(np.int64) for x in arrays[1:])
        order = np.lexsort((*doc[::-1], other, hashes))
        a, b, doc = hashes[order], other[order], [x[order] for x in doc]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        least = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(a) else order
        out = np.zeros(len(a), np.uint64)
        out[order] = np.any([x != x[least] for x in doc], axis=0)
        return out


def _send(size: int, facts: _Shared):
    @gives_back
    def run(key, table):
        values, _ = _Windows(table, size, 1).short(facts.p)
        return facts.messages(key[0].as_py(), values, [])

    return run


def _ask(size: int, facts: _Later):
    @gives_back
    def run(table, marks):
        if not len(table):
            return facts.messages(0, np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * 4)
        w = _Windows(table, size, 2)
        found = w.suspects(facts.p, marks.to_pylist())
        doc = np.repeat(np.arange(len(w.n)), w.n)[w.first[found]]
        ids, ties = w.rows["doc_id"], w.rows[X.TIE].to_numpy()
        none, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        own = [none.astype(np.uint64), ids.astype(np.int64).view(np.uint64), ties.view(np.uint64)]
        return facts.messages(table[X.CHUNK][0].as_py(), w.hashes[0][found], [w.hashes[1][found], *(x[doc] for x in own)])

    return run


def _cut(size: int, p: X.Plan):
    @gives_back
    def run(docs, marks):
        w = _Windows(docs, size, 2)
        found = w.suspects(p, _of(marks, 1))
        later = np.zeros(len(w.first), bool)
        later[found] = X.told(_of(marks, 2), X.cells(w.hashes[0][found], p.buckets))
        removed = later[w.place] | (w.first[w.place] != np.arange(len(w.place)))
        edge = np.zeros(int(w.n_words.sum()) + 1, np.int64)
        edge += np.bincount(w.starts[removed], minlength=len(edge))
        edge -= np.bincount(w.starts[removed] + size, minlength=len(edge))
        gone = np.cumsum(edge)[:-1] > 0
        ends = np.r_[0, np.cumsum(w.n_words)]
        total = np.r_[0, np.cumsum(gone)]
        n_removed = total[ends[1:]] - total[ends[:-1]]
        texts = w.rows["text"]
        if n_removed.any():
            texts = pa.array([without(t.as_py(), gone[ends[i] : ends[i + 1]]) if n_removed[i] else t.as_py() for i, t in enumerate(texts)], pa.string())
        return pa.table([w.rows["doc_id"], texts, w.rows[X.REST], pa.array(w.n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", X.REST, "__lm_words", "__lm_removed"])

    return run


def without(text: str, gone: np.ndarray) -> str:
    """``text`` without the words marked, and without the white space before each removed run (after it, at the start)."""
    data = text.encode()
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    spans = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(data[at : spans[a - 1][1] if a else 0])
        at = spans[b - 1][1] if a or b == len(spans) else spans[b][0]
    out.append(data[at:])
    return b"".join(out).decode()


def drop_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = X.CHUNK_BYTES, counts: tuple[str, str] | None = ("n_words", "n_removed")) -> DataFrame:
    """Cut every word of a ``size``-word window that also starts earlier in the corpus.

    Words are runs of other characters than space and U+0009 to U+000D, as they stand.
    Earlier means a smaller id (null last), or an earlier start in the same document;
    windows are judged on the input. A first exchange of short Rabin-Karp hashes finds
    the windows that several chunks may hold; a second one compares two independent
    61-bit hashes of these and tells which an earlier document of another chunk holds.
    Repeated windows merge into maximal intervals, whose words go with the white space
    before them; all else of a text stays as it is, and a text that loses nothing is
    untouched. A null text stays null. Rows that share an id, or have none, are in the
    order of a hash of their texts, and equal rows count as repeats in any order.
    All columns stay; ``counts`` names two more, words and removed words. A name that a
    column of ``docs`` has already gets ``repeats_`` before it; None adds no counts.
    An empty table gives an empty result.
    """
    p = X.plan(docs, text, chunk_bytes)
    part = X.dealt(docs, p.chunks, id_col, text)
    by_chunk = lambda: part.groupBy(X.CHUNK)
    shared, later = _Shared(p, p.bits), _Later(p)
    marks = shared.answered(by_chunk().applyInArrow(_send(size, shared), shared.ddl))
    asked = by_chunk().cogroup(marks.groupBy(X.CHUNK)).applyInArrow(_ask(size, later), later.ddl)
    marks = marks.withColumn("round", F.lit(1)).unionByName(later.answered(asked).withColumn("round", F.lit(2)))
    numbers = [T.StructField(c, T.LongType()) for c in ("__lm_words", "__lm_removed")]
    schema = T.StructType([T.StructField("doc_id", part.schema["doc_id"].dataType), T.StructField("text", T.StringType()), part.schema[X.REST], *numbers])
    cut = by_chunk().cogroup(marks.groupBy(X.CHUNK)).applyInArrow(_cut(size, p), schema)
    kept = [(F.col("doc_id") if c == id_col else F.col("text") if c == text else F.col(X.REST)[c]).alias(c) for c in docs.columns]
    more = []
    for name, value in zip(counts or (), ("__lm_words", "__lm_removed"), strict=False):
        while name in docs.columns:
            name = f"repeats_{name}"
        more.append(F.col(value).alias(name))
    return cut.select(*kept, *more)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeats(docs)
    kept = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM t WHERE len(w) >= 20
), h AS (
  SELECT doc_id, s, md5_number(array_to_string(w[s:s + 19], ' ')) AS k FROM i
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM h) WHERE n > 1
), g AS (
  SELECT DISTINCT doc_id, s + o AS p FROM r, (SELECT unnest(range(20)) AS o)
), l AS (
  SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id
), f AS (
  SELECT t.doc_id, w, coalesce(ps, []) AS ps FROM t LEFT JOIN l USING (doc_id)
), u AS (
  SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)
), k AS (
  SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY u.doc_id
)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM f LEFT JOIN k ON k.doc_id = f.doc_id
"""
