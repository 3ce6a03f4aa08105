"""Best-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .store import materialize, new_path
from .tokens import encoder
from .words import give_back

#: Documents that are cut into pieces at once.
ROWS = 256
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Token ids of every document and an end id, cut into pieces of ``capacity``.

    Only longer documents are cut; all their pieces but the first are full. ``ids``
    holds a piece's ids as little-endian unsigned 32-bit numbers. A null text is empty,
    so its one piece is the end id. Repeated rows and null ids are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                    ids = np.append(enc.encode(text.as_py()).astype("<u4"), np.uint32(end_id)).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        for to, x in zip(out, (doc, k, a, b - a, ids[a:b].tobytes()), strict=True):
                            to.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])
            batch = rows = out = None
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def sweep(events: list[tuple]) -> tuple[list[tuple], list[tuple], list[list]]:
    """Match items with slots in one pass from the largest size to the smallest.

    ``events`` are runs in falling order of size, slots before items: (size, 0, run, a, b)
    for the slots a to b of a run of gaps, (size, 1, rank, n) for n equal items. The last
    slot met that is still free is the smallest that fits: the item's successor. Equal
    items meet equal slots by rank. Returns matches (size, rank, n, run, slot), items
    that found none, and the slots left, each run's in order.
    """
    matches, unmatched, free = [], [], []
    for size, kind, first, *rest in events:
        if kind == 0:
            free.append([size, first, *rest])
            continue
        rank, n = first, rest[0]
        while n and free:
            top = free[-1]
            take = min(n, top[3] - top[2])
            if take:
                matches.append((size, rank, take, top[1], top[2]))
                rank, n, top[2] = rank + take, n - take, top[2] + take
            if top[2] == top[3]:
                free.pop()
        if n:
            unmatched.append((size, rank, n))
    return matches, unmatched, free


def filled(first: int, n: int, gap: int, q: int, capacity: int, matches: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """What a run of ``n`` sequences with equal gaps becomes when items take some of their slots.

    Sequence k of the run has the slots k * q to k * q + q - 1. ``matches`` are (slot, n,
    size, rank), in order of slots. Returns new runs (gap, first, n) and segments (size,
    rank, n, sequence, per, offset): the i-th item of a segment stands in sequence
    + i // per, and i % per items behind the offset.
    """
    used, runs, segments = capacity - gap, [], []
    at = 0  # the first sequence that is not settled
    mixed: list[tuple] = []  # what stands in the sequence ``at`` by now

    def settle(upto: int) -> None:
        nonlocal at, mixed
        if mixed:
            offset = used
            for size, rank, count in mixed:
                segments.append((size, rank, count, first + at, count, offset))
                offset += size * count
            runs.append((capacity - offset, first + at, 1))
            at, mixed = at + 1, []
        if upto > at:
            runs.append((gap, first + at, upto - at))
            at = upto

    for slot, count, size, rank in matches:
        settle(slot // q) if slot // q > at else None
        while count:
            if slot % q == 0 and count >= q:
                if mixed:
                    settle(at)
                whole = count // q
                segments.append((size, rank, whole * q, first + at, q, used))
                runs.append((gap - q * size, first + at, whole))
                at, slot, count, rank = at + whole, slot + whole * q, count - whole * q, rank + whole * q
                continue
            take = min(count, q - slot % q)
            mixed.append((size, rank, take))
            slot, count, rank = slot + take, count - take, rank + take
            if slot % q == 0:
                settle(at)
    settle(n)
    return [r for r in runs if r[0] and r[2]], segments


GAP, ITEM, MATCH, SEGMENT, NEXT = range(5)
_STATE = ("kind", "size", "first", "n", "run", "slot", "per", "offset")
_STATE_DDL = "kind int, size int, first bigint, n bigint, run bigint, slot bigint, per int, offset int"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(_STATE))


def _slots(gap: int, hi: int) -> int:
    """Slots of a gap for items up to ``hi``: as many as fit whatever their lengths, and one at least."""
    return max(1, gap // hi)


def _events(rows: list[tuple], lo: int, hi: int) -> list[tuple]:
    """Runs of slots and of the class's items as ``sweep`` takes them; a gap run's slots already taken are left out."""
    out = []
    for kind, size, first, n, _, slot, *_ in rows:
        if kind == GAP and size > lo:
            q = _slots(size, hi)
            if slot < n * q:
                out.append((size // q, 0, first, slot, n * q))
        elif kind == ITEM and lo < size <= hi:
            out.append((size, 1, first, n))
    return sorted(out, key=lambda e: (-e[0], *e[1:]))


def _tuples(table: pa.Table) -> list[tuple]:
    return list(zip(*[table[c].to_pylist() for c in _STATE], strict=True))


def _local(lo: int, hi: int):
    """The sweep within a range of sizes; gaps say how many of their slots are taken."""

    def run(table: pa.Table) -> pa.Table:
        rows = _tuples(table)
        matches, left, _ = sweep(_events(rows, lo, hi))
        taken: dict[int, int] = {}
        for _, _, n, first, slot in matches:
            taken[first] = max(taken.get(first, 0), slot + n)
        out = [(*r[:5], taken.get(r[2], 0), *r[6:]) if r[0] == GAP else r for r in rows if not (r[0] == ITEM and lo < r[1] <= hi)]
        out += [(ITEM, size, rank, n, None, 0, None, None) for size, rank, n in left]
        return _rows(out + [(MATCH, size, rank, n, first, slot, None, None) for size, rank, n, first, slot in matches])

    return run


def _global(lo: int, hi: int, capacity: int, patience: int):
    """The sweep over what the ranges left, then gaps are updated and swept again until the class is placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in _tuples(pa.Table.from_batches([b]))]
        matches, left, _ = sweep(_events(rows, lo, hi))
        matches += [(size, first, n, run_, slot) for kind, size, first, n, run_, slot, *_ in rows if kind == MATCH]
        gaps = [(size, first, n) for kind, size, first, n, *_ in rows if kind == GAP]
        place = max((first for kind, _, first, *_ in rows if kind == NEXT), default=0)
        out = [(ITEM, size, first, n, None, 0, None, None) for kind, size, first, n, *_ in rows if kind == ITEM and not lo < size <= hi]
        turn = 1
        while True:
            of: dict[int, list] = {}
            for size, rank, n, first, slot in matches:
                of.setdefault(first, []).append((slot, n, size, rank))
            now = []
            for gap, first, n in gaps:
                if first not in of:
                    now.append((gap, first, n))
                    continue
                runs, segments = filled(first, n, gap, _slots(gap, hi), capacity, sorted(of[first]))
                now += runs
                out += [(SEGMENT, *x[:3], x[3], None, x[4], x[5]) for x in segments]
            some, rest, gaps = sum(m[2] for m in matches), sum(n for _, _, n in left), now
            if not rest:
                break
            if 10 * some <= some + rest or turn >= patience:
                fresh = -(-sum(size * n for size, _, n in left) // capacity)
                gaps.append((capacity, place, fresh))
                place += fresh
            turn += 1
            free = [(GAP, gap, first, n, None, 0) for gap, first, n in gaps]
            matches, left, _ = sweep(_events(free + [(ITEM, size, rank, n, None, 0) for size, rank, n in left], lo, hi))
        out += [(GAP, gap, first, n, None, 0, None, None) for gap, first, n in gaps]
        out.append((NEXT, None, place, None, None, None, None, None))
        yield from _rows(out).to_batches()

    return run


def supersteps(items: DataFrame, capacity: int, patience: int = 5, ranges: int = 4) -> list[str]:
    """Place runs of equal items (length, n) by rounds; returns the folders whose SEGMENT rows say where.

    A superstep is a halving class of lengths, longest first. It range-sorts the class's
    items and the slots of all gaps that could take one, sweeps each range for
    successors, sweeps what the ranges left, updates the gaps, and repeats until the
    class is placed; items that find no gap open sequences when a sweep places less
    than a tenth of them, or after ``patience`` sweeps. Items of a length and
    sequences of a gap stand as runs, so a state has some thousand rows, bounded by the
    capacity, however many documents there are.
    """
    spark = items.sparkSession
    kind = lambda k: F.lit(k).alias("kind")
    nil = [F.lit(None).cast(t).alias(c) for c, t in (("run", "bigint"), ("slot", "bigint"), ("per", "int"), ("offset", "int"))]
    state = items.select(kind(ITEM), F.col("length").cast("int").alias("size"), F.lit(0).cast("bigint").alias("first"), "n", *nil)
    paths: list[str] = []
    while True:
        longest = state.where(F.col("kind") == ITEM).agg(F.max("size")).first()[0]
        if longest is None:
            return paths
        hi = capacity
        while hi // 2 >= longest:
            hi //= 2
        lo = hi // 2
        # Slots of a gap are at least as long as the longest item of the class, or the gap itself.
        q = F.greatest(F.lit(1), F.floor(F.col("size") / hi))
        size = F.when(F.col("kind") == GAP, F.floor(F.col("size") / q)).otherwise(F.coalesce("size", F.lit(0)))
        block = F.floor(size * ranges / (2 * hi)).cast("int").alias("block")
        swept = state.where(F.col("kind") != SEGMENT).groupBy(block).applyInArrow(_local(lo, hi), _STATE_DDL)
        path = new_path(spark, "superstep")
        swept.coalesce(1).mapInArrow(_global(lo, hi, capacity, patience), _STATE_DDL).write.parquet(path)
        paths.append(path)
        state = spark.read.schema(_STATE_DDL).parquet(path)


#: Ranks that a row of the join between pieces and segments spans at most.
SPAN = 1 << 16


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    Pieces are range-sorted by length and numbered within it; ``supersteps`` match them
    with gaps. Pieces of a length are interchangeable, so conflicts between them are
    resolved by rank alone: an equi-join on the length and blocks of ranks tells each
    its place. Repeated rows are packed each. An empty input gives an empty result; a
    length out of bounds raises ValueError.
    """
    spark = cut.sparkSession
    order = [F.col(c) for c in ("doc_id", "piece") if c in cut.columns]
    placed = ranked(cut, ["length"], order, "_rank")
    items = materialize(placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    least, most = items.agg(F.min("length"), F.max("length")).first()
    if least is None:
        return cut.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))
    if not 0 < least <= most <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    segments = spark.read.schema(_STATE_DDL).parquet(*supersteps(items, capacity)).where(F.col("kind") == SEGMENT)
    last = F.col("first") + F.col("n") - 1
    spans = F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(last / SPAN)))
    table = segments.select(F.col("size").cast("bigint").alias("_l"), F.col("first").alias("_lo"), last.alias("_hi"), F.col("run").alias("_seq"), F.col("per").alias("_per"), F.col("offset").alias("_off"), spans.alias("_b"))
    rank = F.col("_rank")
    joined = placed.join(table, (F.col("length") == F.col("_l")) & (F.floor(rank / SPAN) == F.col("_b")) & rank.between(F.col("_lo"), F.col("_hi")))
    k = rank - F.col("_lo")
    joined = joined.withColumn("sequence_id", F.col("_seq") + F.floor(k / F.col("_per"))).withColumn("offset", F.col("_off") + k % F.col("_per") * F.col("length"))
    return joined.drop("_rank", "_l", "_lo", "_hi", "_seq", "_per", "_off", "_b")


def query(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digest(docs: DataFrame) -> DataFrame:
    """Pack all documents; the ids stand as their CRC-32."""
    cut = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = pack(materialize(cut, "pieces"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
