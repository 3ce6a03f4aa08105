"""Corpus-wide facts about hashed windows, at a few bytes a window.

Documents are dealt to chunks by a hash of their row. A chunk sends each distinct
hash once, sorted and delta-coded, to the bucket of its leading bits; a bucket sends
back one small code for each hash of each chunk that holds something to tell. Hot
hashes cost one entry a chunk, so no bucket grows with a hash's frequency.

Chunks know at most ``FAN`` buckets, so that a message stays worth sending. Where the
corpus needs more, a bucket is split: messages of ``GROUP`` chunks are merged and dealt on
to the parts of their bucket, and answers go back the same way.

A first exchange sends short hashes, of a few bits more than it takes to number all
windows. Equal windows have equal short hashes, so what it finds alone is alone; what
it finds together may not be equal and is looked at again, by its whole hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import gives_back

#: Bytes of text in a chunk, and distinct windows in a bucket, about.
CHUNK_BYTES = 4 << 20
BUCKET_WINDOWS = 2_000_000
#: Bits of a short hash beyond those that number the windows: one alone in 2 ** SPARE_BITS meets another.
SPARE_BITS = 6
CHUNK, REST, TIE = "__lm_chunk", "__lm_rest", "__lm_tie"


#: Buckets that a chunk sends to at most, and chunks whose messages are merged where buckets are split.
FAN, GROUP = 1024, 1024


@dataclass(frozen=True)
class Plan:
    """Numbers of chunks, of buckets and of each bucket's parts (powers of two), and the bits of a short hash."""

    chunks: int
    buckets: int
    parts: int
    bits: int


def plan(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Plan:
    """What suits all of ``docs``: a word takes some six bytes."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    windows = max(1, size / 6)
    all_parts = 1 << max(6, math.ceil(math.log2(max(1, windows / BUCKET_WINDOWS))))
    buckets = min(all_parts, FAN)
    return Plan(max(64, -(-size // chunk_bytes)), buckets, all_parts // buckets, min(64, max(16, math.ceil(math.log2(windows)) + SPARE_BITS)))


def dealt(docs: DataFrame, chunks: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its chunk; all columns but id and text travel in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text)]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), rest.alias(REST), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(TIE)).withColumn(CHUNK, F.pmod(F.xxhash64("doc_id", TIE), F.lit(chunks)).cast("int"))


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; all-zero planes are left out."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    planes = v.view(np.uint8).reshape(-1, 8).T[:width]
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    if raw[0]:
        out[:, : raw[0]] = raw[1:].reshape(raw[0], n).T
    return out.view("<u8").ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(data, n), dtype=np.uint64)


def cells(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Bounds of each bucket's part among sorted hashes of ``bits`` bits."""
    shift = np.uint64(bits - (buckets.bit_length() - 1))
    return np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))


def base(bucket: int, buckets: int, bits: int = 64) -> np.uint64:
    """The smallest hash of a bucket; hashes are sent relative to it."""
    return np.uint64(bucket) << np.uint64(bits - (buckets.bit_length() - 1))


def short(hashes: np.ndarray, p: Plan) -> np.ndarray:
    return hashes >> np.uint64(64 - p.bits)


def table(rows: list[tuple], **kinds) -> pa.Table:
    """Rows of Python values as a table of the given columns."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


class Facts:
    """What goes with each hash of a message, and what its bucket makes of it.

    ``bits``: of the hashes. Subclasses pack arrays of one value a hash into ``FIELDS``
    binary columns, and judge: a whole number for each of a bucket's hashes, 0 if there is
    nothing to tell.
    """

    FIELDS: tuple[str, ...] = ()

    def __init__(self, p: Plan, bits: int = 64):
        self.p, self.bits = p, bits

    def pack(self, arrays: list[np.ndarray]) -> tuple[bytes, ...]:
        return tuple(squeeze(x) for x in arrays)

    def unpack(self, row: dict) -> list[np.ndarray]:
        return [unsqueeze(row[c], row["n"]) for c in self.FIELDS]

    def judge(self, hashes: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    # -- messages ---------------------------------------------------------------

    @property
    def ddl(self) -> str:
        return ", ".join(["bucket int, chunk int, part int, n int, hashes binary", *(f"{c} binary" for c in self.FIELDS)])

    def messages(self, chunk: int, hashes: np.ndarray, arrays: list[np.ndarray], parts: bool = False, bucket: int = 0) -> pa.Table:
        """Sorted hashes of a chunk by bucket, or those of one bucket by its parts."""
        n = self.p.buckets * self.p.parts if parts else self.p.buckets
        first = bucket * self.p.parts if parts else 0
        bounds, out = cells(hashes, n, self.bits), []
        for k in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[k], bounds[k + 1])
            place = (bucket, chunk, int(k) - first) if parts else (int(k), chunk, 0)
            out.append((*place, int(at.stop - at.start), squeeze_sorted(hashes[at] - base(int(k), n, self.bits)), *self.pack([x[at] for x in arrays])))
        b = pa.binary()
        return table(out, bucket=pa.int32(), chunk=pa.int32(), part=pa.int32(), n=pa.int32(), hashes=b, **dict.fromkeys(self.FIELDS, b))

    def received(self, messages: pa.Table, bucket: int, parts: bool):
        """All hashes of some messages, each message's bounds, and the arrays that go with them."""
        rows = messages.to_pylist()
        n = self.p.buckets * self.p.parts if parts else self.p.buckets
        bounds = np.cumsum([0, *(r["n"] for r in rows)])
        hashes = [unsqueeze_sorted(r["hashes"], r["n"]) + base(bucket * self.p.parts + r["part"] if parts else bucket, n, self.bits) for r in rows]
        arrays = [np.concatenate(x) for x in zip(*[self.unpack(r) for r in rows], strict=True)]
        return rows, bounds, np.concatenate(hashes), arrays

    # -- the way there and back -----------------------------------------------------

    def answered(self, sent: DataFrame) -> DataFrame:
        """Answers to all messages: chunk, bucket, n and codes, without those that tell nothing."""
        if self.p.parts == 1:
            return sent.groupBy("bucket").applyInArrow(self._answer(False), ANSWER_DDL).select(F.col("chunk").alias(CHUNK), "bucket", "n", "codes")
        group = F.floor(F.col("chunk") / GROUP).cast("int").alias("group")
        merged = sent.groupBy("bucket", group).applyInArrow(self._merge(), self.ddl)
        told = merged.groupBy("bucket", "part").applyInArrow(self._answer(True), ANSWER_DDL)
        back = sent.groupBy("bucket", group).cogroup(told.groupBy("bucket", F.col("chunk").alias("group")))
        return back.applyInArrow(self._split(), ANSWER_DDL).select(F.col("chunk").alias(CHUNK), "bucket", "n", "codes")

    def _answer(self, parts: bool):
        @gives_back
        def run(key, messages):
            bucket = key[0].as_py()
            rows, bounds, hashes, arrays = self.received(messages, bucket, parts)
            return _answers(bucket, rows, bounds, self.judge(hashes, arrays))

        return run

    def _merge(self):
        @gives_back
        def run(key, messages):
            bucket, group = (k.as_py() for k in key)
            _, _, hashes, arrays = self.received(messages, bucket, False)
            order = np.argsort(hashes, kind="stable")
            return self.messages(group, hashes[order], [x[order] for x in arrays], True, bucket)

        return run

    def _split(self):
        @gives_back
        def run(messages, told):
            if not len(messages):
                return _answers(0, [], np.zeros(1, int), np.zeros(0, int))
            messages = messages.sort_by([("chunk", "ascending")])
            bucket = messages["bucket"][0].as_py()
            rows, bounds, hashes, _ = self.received(messages, bucket, False)
            order = np.argsort(hashes, kind="stable")
            n = self.p.buckets * self.p.parts
            at = cells(hashes[order], n, self.bits)
            codes = np.zeros(len(hashes), np.uint64)
            for r in told.to_pylist():
                k = bucket * self.p.parts + r["part"]
                codes[order[at[k] : at[k + 1]]] = unsqueeze(r["codes"], r["n"])
            return _answers(bucket, rows, bounds, codes)

        return run


ANSWER_DDL = "chunk int, bucket int, part int, n int, codes binary"


def _answers(bucket: int, rows: list[dict], bounds: np.ndarray, codes: np.ndarray) -> pa.Table:
    out = []
    for k, r in enumerate(rows):
        mine = codes[bounds[k] : bounds[k + 1]]
        if mine.any():
            out.append((r["chunk"], bucket, r["part"], len(mine), squeeze(mine.astype(np.uint64))))
    return table(out, chunk=pa.int32(), bucket=pa.int32(), part=pa.int32(), n=pa.int32(), codes=pa.binary())


def told(answers: list[dict], bounds: np.ndarray) -> np.ndarray:
    """The codes of a chunk's hashes, whose parts by bucket end at ``bounds``."""
    out = np.zeros(bounds[-1], np.uint64)
    for r in answers:
        out[bounds[r["bucket"]] : bounds[r["bucket"] + 1]] = unsqueeze(r["codes"], r["n"])
    return out
