"""Jaccard self-join of shingle sets through an R-tree of group counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .components import components
from .store import materialize
from .words import buffers, gives_back, mix, window_hashes, word_hashes

#: Token groups: the coordinates of a point.
GROUPS = 64
#: Points of a leaf, and the representatives of one token that one task compares.
LEAF, BLOCK = 32, 512
#: Representatives in a seed group, about, and rounds of seeding.
SEED_GROUP, SEEDS = 64, 2
_ROUNDS = [np.uint64(0x9FB21C651E98DF25 * (2 * r + 1) & (2**64 - 1)) for r in range(SEEDS)]


class _Sets:
    """The distinct shingles of one chunk's documents: hashes sorted, with the document of each.

    ``values`` and ``count`` are the distinct short hashes and their documents, ``place``
    the number of each shingle's short hash.
    """

    def __init__(self, table: pa.Table, size: int, p: X.Plan):
        self.rows = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), (X.TIE, "ascending")]))
        words, counts = word_hashes(*buffers(self.rows["text"]), lower=True)
        (hashes,), _, n = window_hashes(words, counts, size, whole=True)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(hashes) else np.zeros(0, bool)
        self.hashes, self.doc = hashes[fresh], doc[fresh]
        self.values, self.place, self.count = np.unique(X.short(self.hashes, p), return_inverse=True, return_counts=True)


class _Frequency(X.Facts):
    """Short hashes with a chunk's documents of each; answers with the class of the frequency (0: once; else 1 + log2)."""

    FIELDS = ("counts",)

    def judge(self, hashes, arrays):
        order = np.argsort(hashes, kind="stable")
        h, counts = hashes[order], arrays[0].astype(np.int64)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[: len(h)]
        total = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.r_[first, len(h)])) if len(h) else counts
        out = np.zeros(len(h), np.uint64)
        out[order] = np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0)
        return out


def _send(size: int, facts: _Frequency):
    @gives_back
    def run(key, table):
        s = _Sets(table, size, facts.p)
        return facts.messages(key[0].as_py(), s.values, [s.count])

    return run


def _describe(size: int, p: X.Plan, num: int, den: int):
    @gives_back
    def run(docs, marks):
        s = _Sets(docs, size, p)
        kinds = X.told(marks.to_pylist(), X.cells(s.values, p.buckets, p.bits)).astype(np.int64)[s.place]
        order = np.lexsort((s.hashes, kinds, s.doc))
        h, k, doc = s.hashes[order], kinds[order], s.doc[order]
        n = np.bincount(doc, minlength=len(s.rows))
        ends = np.r_[0, np.cumsum(n)]
        own = np.bincount(doc, weights=k == 0, minlength=len(s.rows)).astype(np.int64)
        sums = [np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(c)))] for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        keys = [(t[ends[1:]] - t[ends[:-1]]).view(np.int64) for t in sums]
        least = -(-num * n // den)
        out = []
        for i in range(len(n)):
            lo, hi = ends[i] + own[i], ends[i + 1]
            if n[i] and hi - lo >= least[i]:
                shared = h[lo:hi]
                seeds = [int(np.argmin(mix(shared ^ c))) for c in _ROUNDS]
                salts = [max(1, (1 << int(k[lo + j])) // SEED_GROUP) for j in seeds]
                out.append((int(n[i] - least[i] + 1 - own[i]), shared.view(np.int64), [int(shared[j].view(np.int64)) for j in seeds], salts))
            else:
                out.append((0, None, None, None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        lists = pa.list_(pa.int64())
        return pa.table([s.rows["doc_id"], pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in keys), pa.array(cols[0], pa.int32()), *(pa.array(x, lists) for x in cols[1:])], names=["doc_id", "n", "k1", "k2", "prefix", "shared", "seeds", "salts"])

    return run


class Tree:
    """A packed R-tree of count vectors: leaves of ``LEAF`` points in the order of size and counts.

    A node knows the largest count of each group and its range of sizes. What two nodes
    can share is at most the sum of their smaller counts; a pair of nodes or points stays
    if that bound reaches ``num`` / (``num`` + ``den``) of the least possible sum of sizes.
    """

    def __init__(self, counts: np.ndarray, n: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(den / num)).astype(np.int64)
        coarse = counts.reshape(len(n), -1, 8).sum(2) if counts.shape[1] % 8 == 0 else counts
        self.order = np.lexsort((n, *(coarse[:, j] >> 2 for j in range(min(3, coarse.shape[1]))), band))
        self.c, self.n = counts[self.order].astype(np.int32), n[self.order]
        starts = np.arange(0, len(n), LEAF)
        self.starts, self.stops = starts, np.minimum(starts + LEAF, len(n))
        self.top = np.maximum.reduceat(self.c, starts, axis=0)
        self.small, self.large = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)

    def _enough(self, bound, size):
        return (self.num + self.den) * bound >= self.num * size

    def pairs(self, label: np.ndarray):
        """Arrays (i, j) of points with different labels whose bound suffices, leaf pair by leaf pair."""
        label = label[self.order]
        same = np.minimum.reduceat(label, self.starts) if len(label) else label
        mixed = np.maximum.reduceat(label, self.starts) != same if len(label) else label
        for a in range(len(self.starts)):
            later = np.arange(a, len(self.starts))
            bound = np.minimum(self.top[a], self.top[a:]).sum(1)
            near = self._enough(bound, self.small[a] + self.small[a:])
            near &= (self.den * self.large[a:] >= self.num * self.small[a]) & (self.den * self.large[a] >= self.num * self.small[a:])
            near &= mixed[a] | mixed[a:] | (same[a:] != same[a])
            for b in later[near]:
                x, y = slice(self.starts[a], self.stops[a]), slice(self.starts[b], self.stops[b])
                share = np.minimum(self.c[x, None, :], self.c[None, y, :]).sum(2)
                ok = self._enough(share, self.n[x, None] + self.n[None, y]) & (label[x, None] != label[None, y])
                if a == b:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                if len(i):
                    best = np.argsort(-share[i, j], kind="stable")
                    yield self.order[i[best] + x.start], self.order[j[best] + y.start]


def point(shared: np.ndarray) -> np.ndarray:
    """Shingles per group: the coordinates of a set."""
    return np.bincount((shared.view(np.uint64) >> np.uint64(17)).astype(np.int64) % GROUPS, minlength=GROUPS)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _seeded(num: int, den: int):
    """Verified links inside each seed group; those that close a circle are left out."""

    @gives_back
    def run(key, table):
        ids, n = table["doc_id"].to_numpy(), table["n"].to_numpy()
        seed, part = table["seed"].to_numpy(), table["part"].to_numpy()
        shared = [np.asarray(x.values.to_numpy()) for x in table["shared"]]
        order = np.lexsort((ids, part, seed))
        cut = np.flatnonzero((np.diff(seed[order]) != 0) | (np.diff(part[order]) != 0)) + 1
        a, b = [], []
        for rows in np.split(order, cut):
            if len(rows) < 2:
                continue
            forest = _Forest(len(rows))
            tree = Tree(np.stack([point(shared[r]) for r in rows]), n[rows], num, den)
            for i, j in tree.pairs(np.arange(len(rows))):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = forest.root(x), forest.root(y)
                    if p != q and (num + den) * _overlap(shared[rows[x]], shared[rows[y]]) >= num * (n[rows[x]] + n[rows[y]]):
                        forest.up[max(p, q)] = min(p, q)
                        a.append(ids[rows[x]])
                        b.append(ids[rows[y]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _met(num: int, den: int):
    """Pairs of different components that share a token of both prefixes and pass the bounds of points and of 16-bit groups."""

    @gives_back
    def run(key, table):
        ids, n, comp = (table[c].to_numpy() for c in ("doc_id", "n", "comp"))
        fine = [np.frombuffer(x.as_py(), "<u4") for x in table["fine"]]
        points = np.stack([np.bincount((f >> 16).astype(np.int64) % GROUPS, minlength=GROUPS) for f in fine]) if fine else np.zeros((0, GROUPS), np.int64)
        at = table["at"].combine_chunks()
        at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
        token, row = at.flatten().to_numpy(), np.repeat(np.arange(len(ids)), pc.list_value_length(at).to_numpy())
        order = np.lexsort((row, token))
        seen, a, b = set(), [], []
        for rows in np.split(row[order], np.flatnonzero(np.diff(token[order])) + 1):
            if len(rows) < 2 or (comp[rows] == comp[rows[0]]).all():
                continue
            tree = Tree(points[rows], n[rows], num, den)
            for i, j in tree.pairs(comp[rows]):
                for x, y in zip(rows[i].tolist(), rows[j].tolist(), strict=True):
                    pair = (min(x, y), max(x, y))
                    if pair in seen:
                        continue
                    seen.add(pair)
                    if (num + den) * _overlap(fine[x], fine[y]) >= num * (n[x] + n[y]):
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


@F.pandas_udf(T.BinaryType())
def _fine(shared: pd.Series) -> pd.Series:
    """16-bit token groups of a set; equal groups are told apart by their number (upper half: group, lower half: number)."""
    out = []
    for s in shared:
        g = np.sort((np.asarray(s).view(np.uint64) >> np.uint64(17)) & np.uint64(0xFFFF)).astype(np.int64)
        first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        number = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else g
        out.append(((g << 16) | np.minimum(number, 0xFFFF)).astype("<u4").tobytes())
    return pd.Series(out)


def shingle_sets(docs: DataFrame, size: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n (distinct shingles), two sums that name the set, and what a link needs.

    A document can link only if ``num`` / ``den`` of its shingles occur in other
    documents too; frequencies are those of short hashes, so never too small. Those that can carry their shared shingles, rarest class first, and
    how many of these stand in the prefix that any partner's prefix must meet.
    """
    p = X.plan(docs, text)
    part = X.dealt(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), p.chunks)
    facts = _Frequency(p, p.bits)
    marks = facts.answered(part.groupBy(X.CHUNK).applyInArrow(_send(size, facts), facts.ddl))
    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, prefix int, shared array<bigint>, seeds array<bigint>, salts array<bigint>"
    return part.groupBy(X.CHUNK).cogroup(marks.groupBy(X.CHUNK)).applyInArrow(_describe(size, p, num, den), schema)


def join(docs: DataFrame, size: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``num`` / ``den`` or more.

    Words are runs of other characters than space and U+0009 to U+000D, A-Z lowered; a
    text of fewer than ``size`` words is one shingle; an empty or null text has none and
    links with nothing. Rows of equal sets are one class, represented by its smallest id;
    classes link with classes. Points (shingle counts of token groups) go to the tasks of
    their prefix tokens, where an R-tree finds pairs whose summed coordinate minima can
    reach the threshold; pairs across components are verified on whole sets. Seed groups
    of like documents are linked first, so that the tree skips what is linked already.
    Rows with a null id link with nothing and have a null component; repeated ids count
    as one vertex. An empty table gives an empty result.
    Returns doc_id, n_shingles and component_id.
    """
    spark = docs.sparkSession
    sets = materialize(shingle_sets(docs, size, num, den, id_col, text), "sets")
    can = sets.where((F.col("prefix") > 0) & F.col("doc_id").isNotNull())
    reps = can.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "prefix", "shared", "seeds", "salts")).alias("r"))
    reps = materialize(reps.select("r.*", "n"), "representatives")
    amount = reps.agg(F.sum(F.size("shared")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(8 * (amount.t or 0) / (4 << 20)))

    linked = None
    for r in range(SEEDS):
        seed = reps.select("doc_id", "n", "shared", F.get("seeds", F.lit(r)).alias("seed"), F.pmod(F.xxhash64("doc_id", F.lit(r)), F.get("salts", F.lit(r))).alias("part"))
        seed = seed.withColumn("_task", F.pmod(F.xxhash64("seed", "part"), F.lit(parts)))
        edges = materialize(seed.groupBy("_task").applyInArrow(_seeded(num, den), "a bigint, b bigint"), "seeded")
        linked = edges if linked is None else linked.unionByName(edges)
    comp = materialize(components(linked), "seeded-components")

    at = F.explode(F.slice("shared", 1, F.col("prefix"))).alias("token")
    known = reps.join(comp, F.col("doc_id") == F.col("v"), "left").select("doc_id", "n", "prefix", "shared", F.coalesce("component", "doc_id").alias("comp"))
    posts = known.select("doc_id", "comp", at)
    # Of a token's documents the largest component's needn't meet each other: blocks of the
    # rest, often few, meet blocks of all.
    held = posts.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("token")
    open_ = held.agg(F.max_by("comp", F.struct("_n", "comp")).alias("major"), F.sum("_n").alias("_n"), F.max("_n").alias("_m")).where(F.col("_m") < F.col("_n"))
    size_ = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select(F.col("token").alias("_t"), "major", size_(F.col("_n")).alias("blocks"), size_(F.col("_n") - F.col("_m")).alias("rest"))
    posts = posts.join(open_, F.col("token") == F.col("_t"))
    b, j = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rest")).cast("int")
    pair = lambda j, b: F.struct(j.alias("j"), b.alias("b"))
    every = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda x: pair(x, b))
    minor = F.when(F.col("comp") != F.col("major"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: pair(j, x))).otherwise(F.array().cast("array<struct<j:int,b:int>>"))
    at_ = F.explode(F.when(F.col("blocks") > 1, F.array_union(every, minor)).otherwise(F.array(pair(F.lit(0), F.lit(0)))))
    posts = posts.select("doc_id", "token", "blocks", at_.alias("_p"))
    # A token of several blocks is a matter of its own; others share tasks.
    task = F.when(F.col("blocks") > 1, F.xxhash64("token", "_p.j", "_p.b")).otherwise(F.pmod(F.xxhash64("token"), F.lit(parts)))
    posts = posts.groupBy(task.alias("_task"), "doc_id").agg(F.collect_list("token").alias("at"))
    fine = known.select(F.col("doc_id").alias("_d"), "n", "comp", _fine("shared").alias("fine"))
    posts = posts.join(fine, F.col("doc_id") == F.col("_d")).drop("_d")
    met = posts.groupBy("_task").applyInArrow(_met(num, den), "a bigint, b bigint")
    met = materialize(met.distinct(), "met")

    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    true = both.where((num + den) * shared >= num * (F.col("na") + F.col("nb"))).select("a", "b")
    comp = components(linked.unionByName(materialize(true, "links")))

    names = can.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    names = names.join(comp, F.col("rep") == F.col("v"), "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n", "k1", "k2", "prefix").join(names, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("prefix") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each component.

    Of rows that share an id one stays. Rows of null ids and of empty texts stay.
    """
    found = join(docs, **how).where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    marks = found.agg(F.max(F.col("component_id") != F.col("doc_id")).alias("__lm_gone"), (F.count(F.lit(1)) > 1).alias("__lm_again"))
    marks = materialize(marks.where("__lm_gone OR __lm_again").withColumnRenamed("doc_id", "__lm_id"), "marks")
    marked = docs.join(marks, F.col("doc_id") == F.col("__lm_id"), "left")
    once = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    again = marked.where("NOT __lm_gone AND __lm_again").withColumn("__lm_no", F.row_number().over(once)).where(F.col("__lm_no") == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(F.col("__lm_id").isNull()).select(*columns).unionByName(again.select(*columns))


def query(spark, sf_dir):
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN [md5(array_to_string(w[i:i + 4], ' ')) FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END)) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM t UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) c ON c.v = t.doc_id
"""
