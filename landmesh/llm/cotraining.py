"""Quality classifier: two views of a document teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize
from .words import buffers, give_back, word_hashes

WORD_CELLS, LANG_CELLS, SOURCE_CELLS = 512, 16, 64
N_TEXT = 256 + WORD_CELLS + 3
N_META = LANG_CELLS + SOURCE_CELLS + 3


def text_view(column: pa.Array) -> np.ndarray:
    """What a text says: byte shares, shares of hashed words, length and variety. A null is an empty text."""
    data, ends = buffers(column)
    out = np.zeros((len(ends) - 1, N_TEXT), np.float32)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (512 << 10), "right")) - 1)
        hi = min(hi, len(out))
        part, e = data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        n = hi - lo
        size = np.diff(e)
        if n == 1:
            for a in range(0, len(part), 1 << 20):
                out[lo, :256] += np.bincount(part[a : a + (1 << 20)], minlength=256)
        else:
            out[lo:hi, :256] = np.bincount(np.repeat(np.arange(n) * 256, size) + part, minlength=n * 256).reshape(n, 256)
        out[lo:hi, :256] = np.sqrt(out[lo:hi, :256] / np.maximum(size, 1)[:, None])
        (words,), count = word_hashes(part, e)
        doc = np.repeat(np.arange(n), count)
        cell = (words % np.uint64(WORD_CELLS)).astype(np.int64)
        hist = np.bincount(doc * WORD_CELLS + cell, minlength=n * WORD_CELLS).reshape(n, WORD_CELLS)
        many = np.maximum(count, 1)
        out[lo:hi, 256 : 256 + WORD_CELLS] = np.sqrt(hist / many[:, None])
        # One sorted key for each word: its document, then what is left of the hash.
        bits = np.uint64(max(1, n.bit_length()))
        key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (words >> bits))
        fresh = np.r_[True, key[1:] != key[:-1]][: len(key)]
        distinct = np.bincount((key[fresh] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
        out[lo:hi, -3] = np.log1p(count)
        out[lo:hi, -2] = np.log(np.maximum(distinct, 1) / many)
        out[lo:hi, -1] = np.log1p(size / many)
        lo = hi
    give_back()
    return out


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """What stands beside the text: language, source and length cells; nulls have a cell of their own."""
    n = len(batch)
    out = np.zeros((n, N_META), np.float32)
    rows = np.arange(n)
    out[rows, batch["lang_cell"].to_numpy()] = 1
    out[rows, LANG_CELLS + batch["source_cell"].to_numpy()] = 1
    chars = np.asarray(batch["n_chars"].fill_null(-1).to_numpy(), np.float64)
    out[:, -3] = chars < 0
    out[:, -2] = np.log1p(np.maximum(chars, 0))
    out[:, -1] = out[:, -2] ** 2
    return out


def _views(docs: DataFrame, *more: str) -> DataFrame:
    cell = lambda c, n: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n - 1)) + 1).cast("int")
    return docs.select("doc_id", F.col("text"), cell("lang", LANG_CELLS).alias("lang_cell"), cell("source", SOURCE_CELLS).alias("source_cell"), F.col("n_chars").cast("bigint").alias("n_chars"), *more)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Logistic regression on standardized features, then Platt's calibration of its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * (((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1]) + self.b


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12, mean=0.0, scale=1.0) -> np.ndarray:
    """Weights and intercept of ridge logistic regression on ``(x - mean) / scale``; the intercept is free."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        hessian, gradient = np.diag(penalty), -penalty * w
        for lo in range(0, len(x), 512):
            part = (x[lo : lo + 512] - mean) / scale
            part = np.c_[part, np.ones(len(part))]
            p = _sigmoid(part @ w)
            s = np.maximum(p * (1 - p), 1e-6)
            hessian += (part * s[:, None]).T @ part
            gradient += part.T @ (y[lo : lo + 512] - p)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 20.0) -> Model:
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-6, scale, 1.0)
    return Model(mean, scale, newton(x, y, ridge, mean=mean, scale=scale))


def calibrate(m: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt's scaling on held-out rows."""
    w = newton(m.logit(x)[:, None], y, 1e-2)
    m.a, m.b = float(max(w[0], 0.0)) * m.a, float(w[0] * m.b + w[1])
    return m


@dataclass
class Classifier:
    text: Model
    meta: Model
    mix: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(t), _sigmoid(m), _sigmoid(self.mix[0] * t + self.mix[1] * m + self.mix[2])


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, rounds: int = 3) -> Classifier | None:
    """Fit both views on labelled rows, let each hand the other its surest pseudo-labels, then combine.

    Every fourth labelled row is held out for calibration. In a round
    ``surest(models, taken)`` gives, for each calibrated view, documents that it is sure
    of (ids, both views, labels) and that are not among those taken; they join the other
    view's training rows. The views' calibrated logits are weighted by a regression on
    the held-out rows. None if a class is missing.
    """
    held = np.arange(len(y)) % 4 == 3
    if not (0 < y[~held].sum() < (~held).sum()) or not (0 < y[held].sum() < held.sum()):
        return None
    given = [(np.zeros(0, np.int64), np.zeros((0, v.shape[1]), np.float32), np.zeros(0)) for v in views]
    models: list[Model] = []
    for turn in range(rounds + 1):
        models = []
        for v in range(2):
            _, rows, labels = given[v]
            models.append(calibrate(fit(np.concatenate([views[v][~held], rows]), np.concatenate([y[~held], labels])), views[v][held], y[held]))
        if turn == rounds:
            break
        picked = surest(models, [given[1][0], given[0][0]])
        for v, (ids, rows, labels) in enumerate(picked):
            given[1 - v] = tuple(np.concatenate(x) for x in zip(given[1 - v], (ids, rows[1 - v], labels), strict=True))
        if not sum(len(ids) for ids, _, _ in picked):
            break
    logits = np.c_[models[0].logit(views[0][held]), models[1].logit(views[1][held])]
    return Classifier(models[0], models[1], newton(logits, y[held], 1.0))


def _sample(docs: DataFrame, picked: DataFrame) -> pa.Table:
    """Both views of the picked documents, in the order of a hash of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = text_view(batch["text"]), meta_view(batch)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["good"], pa.FixedSizeListArray.from_arrays(pa.array(t.ravel()), N_TEXT).cast(pa.list_(pa.float32())), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), N_META).cast(pa.list_(pa.float32()))], names=["doc_id", "good", "t", "m"])

    rows = _views(docs).join(F.broadcast(picked), "doc_id")
    # An id that stands in many rows is one document: its smallest row.
    first = F.min(F.struct("text", "lang_cell", "source_cell", "n_chars", "good")).alias("x")
    rows = rows.groupBy("doc_id").agg(first).select("doc_id", "x.*")
    table = rows.mapInArrow(run, "doc_id bigint, good int, t array<float>, m array<float>").toArrow()
    return table.sort_by([("doc_id", "ascending")])


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table[c].combine_chunks().flatten().to_numpy().reshape(-1, n) for c, n in (("t", N_TEXT), ("m", N_META)))


def surest_ids(docs: DataFrame, labels: DataFrame, models: list[Model], taken: list[np.ndarray], per_round: int, sure: float) -> DataFrame:
    """doc_id, view and good of the documents without a label that a view is surest of, up to ``per_round`` of each class.

    All documents are scored where they lie; ids and logits of those that a view is at
    least ``sure`` of are all that moves. A view passes over the ids in its ``taken``.
    """
    cut = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids = part["doc_id"].to_numpy()
                z = [np.where(np.isin(ids, t), 0.0, np.round(m.logit(x), 6)) for m, x, t in zip(models, (text_view(part["text"]), meta_view(part)), taken, strict=True)]
                good = np.maximum(np.abs(z[0]), np.abs(z[1])) >= cut
                yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(z[0][good]), pa.array(z[1][good])], names=["doc_id", "z0", "z1"])

    z = _views(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id bigint, z0 double, z1 double")
    z = z.join(labels.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.max(F.struct("z0", "z1")).alias("z")).select("doc_id", "z.*")
    z = materialize(z, "sure")
    tops = []
    for v in range(2):
        for good in (1, 0):
            far = F.col(f"z{v}") if good else -F.col(f"z{v}")
            top = z.where(far >= cut).orderBy(far.desc(), F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(per_round)
            tops.append(top.select("doc_id", F.lit(v).alias("view"), F.lit(good).alias("good")))
    return materialize(reduce(DataFrame.unionByName, tops), "surest")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4096, per_round: int = 256, sure: float = 0.97) -> Classifier | None:
    """Fit on at most ``most_labelled`` labelled documents and the surest of all others.

    The labelled ones are those of the smallest hash of their ids. In each round every
    document without a label is scored in the executors; only the surest, ``per_round``
    a class and view, come to the driver. Of several labels of one document the lowest
    counts; null labels count as none.
    """
    few = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    table = _sample(docs, few.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_labelled))
    if not len(table):
        return None

    def surest(models: list[Model], taken: list[np.ndarray]):
        top = surest_ids(docs, labels, models, taken, per_round, sure)
        found = _sample(docs, top.select("doc_id", F.lit(-1).alias("good")).distinct())
        ids, at = np.unique(found["doc_id"].to_numpy().astype(np.int64), return_index=True)
        rows = tuple(x[at] for x in _arrays(found)) if len(ids) else (np.zeros((0, N_TEXT), np.float32), np.zeros((0, N_META), np.float32))
        told = [(r.doc_id, r.view, r.good) for r in top.collect()]
        out = []
        for v in range(2):
            mine = sorted((i, g) for i, view, g in told if view == v)
            k = np.searchsorted(ids, np.array([i for i, _ in mine], np.int64))
            out.append((ids[k], tuple(x[k] for x in rows), np.array([g for _, g in mine], float)))
        return out

    good = np.array(table["good"].to_numpy()).astype(float)
    views = _arrays(table)
    del table
    try:
        return cotrain(views, good, surest)
    finally:
        del views
        give_back()


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **bounds) -> DataFrame:
    """Scores of all documents: doc_id, text_score, meta_score, score and kept.

    ``kept`` is a combined score of at least ``least``. A null or empty text is scored
    as it is. Without labels of both classes nothing is rejected and the scores are
    null. Rows are scored one by one, so repeated rows get equal scores; documents need
    doc_id, text, lang, source and n_chars, other columns are ignored.
    """
    model = train(docs, labels, **bounds)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("text_score"), nothing.alias("meta_score"), nothing.alias("score"), F.lit(True).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                t, m, s = (np.round(x, 9) for x in model.scores(text_view(part["text"]), meta_view(part)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(t), pa.array(m), pa.array(s), pa.array(s >= least)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return _views(docs).mapInArrow(run, "doc_id bigint, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **bounds) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``classify`` keeps."""
    model = train(docs, labels, **bounds)
    if model is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # The text travels once, inside its row.
    views = _views(docs.select("doc_id", "text", "lang", "source", "n_chars", row.alias("row")), "row").drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                score = np.round(model.scores(text_view(pc.struct_field(part["row"], "text")), meta_view(part))[2], 9)
                yield part.select(["row"]).filter(pa.array(score >= least))

    return views.mapInArrow(run, T.StructType([views.schema["row"]])).select("row.*")


def query(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
