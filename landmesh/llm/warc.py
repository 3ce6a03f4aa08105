"""WARC archives: a writer with revisits and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_whole, write_whole
from .store import filesystem, materialize, new_path

#: Bytes of an archive, about; a record is never split.
ARCHIVE_BYTES = 16 << 20
LEAST_SHARED = 1000
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
BLANK = re.compile(rb"\r?\n\r?\n")
#: Bytes read at once; of a header and of a block at most; and of records that wait for their member's end.
STEP, HEADER_MOST, RECORD_MOST, HOLD = 64 << 10, 64 << 20, 1 << 30, 32 << 20
#: Digests that are checked.
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
#: Copies of a shared payload's holder, over which its pages are dealt when they are joined.
SALTS = 8
_FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inner_start", pa.int64()), ("inner_stop", pa.int64()), ("problem", pa.string())]
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, path string, start bigint, stop bigint, inner_start bigint, inner_stop bigint, problem string"


# -- writing --------------------------------------------------------------------


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record; a revisit carries the HTTP head without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {_line(uri)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def member(data: bytes, level: int = 3) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def digested(pages: DataFrame) -> DataFrame:
    """Digest every page's payload; ``pages`` has page_id, url and html, a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("bigint"))
    return p


def holders(pages: DataFrame) -> DataFrame:
    """Digest and holder of each payload that several pages may share."""
    big = pages.where(F.col("size") >= LEAST_SHARED).select("page_id", "digest", "size")
    return big.groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as gzip members into archives under ``folder``; returns path and records of each archive.

    Of equal payloads of at least 1000 bytes that with the largest page id holds it, the
    others revisit it; smaller ones hold their own. Null ids are smaller than all others,
    and rows that repeat the largest id all hold the payload. No pages make no archive.
    Only the shared payloads' digests are joined back. A page that revisits sends no
    payload. A task writes its archives whole, under names that depend on its
    partition alone, so a repeated task replaces them.
    """
    d = digested(pages)
    # Digests of repeated payloads only: one row each, and the join splits a frequent one.
    shared = materialize(holders(d), "holders").select(F.col("digest").alias("_d"), F.col("size").alias("_s"), "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_p"))
    part = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    rows = d.join(shared, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")) & (part == F.col("_p")), "left")
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("holder")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, parts, size, n, k = TaskContext.get().partitionId(), [], 0, 0, 0
        done: list[tuple[str, int]] = []

        def close():
            nonlocal parts, size, n, k
            if parts:
                done.append((write_whole(folder, f"part-{part:06d}-{k:04d}.warc.gz", b"".join(parts)), n))
                parts, size, n, k = [], 0, 0, k + 1

        for batch in batches:
            for i in range(len(batch)):
                page, url, payload, digest, length, refers = (batch.column(c)[i].as_py() for c in range(6))
                kind = "response" if refers is None else "revisit"
                one = member(record(kind, _urn(page), url or "", payload or b"", digest, length, None if refers is None else _urn(refers)))
                parts.append(one)
                size, n = size + len(one), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return materialize(rows.mapInArrow(run, "path string, records bigint"), "archives")


def _urn(page: int | None) -> str:
    return f"urn:page:{'null' if page is None else page}"


# -- reading --------------------------------------------------------------------


class Archive:
    """Bytes of a file at any place, read in blocks of which the last is kept."""

    def __init__(self, file, size: int, block: int = 4 << 20):
        self.file, self.size, self.block, self.at, self.held = file, size, block, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; none at the end only."""
        if not self.at <= at < self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(self.block)
        return self.held[at - self.at : at - self.at + n]

    def window(self, at: int) -> Window:
        place = at

        def more() -> bytes:
            nonlocal place
            data = self.read(place, STEP)
            place += len(data)
            return data

        return Window(more, at)


class Window:
    """The part of a stream that is being looked at: it grows at its end and is cut at its start."""

    def __init__(self, more, start: int = 0):
        self.more, self.start, self.data, self.ended = more, start, bytearray(), False

    def has(self, stop: int) -> bool:
        """Pull bytes until the stream is there up to ``stop``; false if it ends before."""
        while not self.ended and self.start + len(self.data) < stop:
            data = self.more()
            self.data += data
            self.ended = not data
        return self.start + len(self.data) >= stop

    def get(self, a: int, b: int) -> bytes:
        self.has(b)
        return bytes(self.data[a - self.start : b - self.start])

    def cut(self, at: int) -> None:
        del self.data[: at - self.start]
        self.start = at

    def find(self, pattern: re.Pattern, at: int, most: int | None = None, cut: bool = False) -> re.Match | None:
        """The first match from ``at`` on, within ``most`` bytes; ``cut`` forgets what was searched."""
        begin = at
        while True:
            found = pattern.search(self.data, at - self.start)
            if found or (most is not None and self.start + len(self.data) - begin > most):
                return found
            at = max(at, self.start + len(self.data) - 16)
            if cut:
                self.cut(at)
            if not self.has(self.start + len(self.data) + 1):
                return None

    @property
    def stop(self) -> int:
        return self.start + len(self.data)


def salvage(data, path: str = "", size: int | None = None) -> Iterator[dict]:
    """All good records of an archive in order, and a row for each gap between them.

    ``data`` is the archive's bytes, or an open file of ``size`` bytes, which is read as
    a stream: what is held at once is one record, or ``HOLD`` bytes of records that wait
    for their member's checksum. Checked are gzip's CRC, the header's form, the block's
    length and the digests in hexadecimal or base 32; digests by algorithms that are not
    known are passed over. After a failed check the search goes on one byte further for
    the next gzip member or version line that yields a good record; what lies between is
    one gap, logged with its bytes and the first problem found in it. Inside a sound
    member the search goes by version lines, and a gap also names its inflated bytes.
    Of a member that ends early its whole records are kept, of one that fails otherwise
    those whose digest holds.
    """
    a = Archive(io.BytesIO(data), len(data)) if size is None else Archive(data, size)
    at, bad, why, w = 0, None, "", a.window(0)
    while at < a.size:
        w.cut(at)
        if w.get(at, at + 3) == MAGIC:
            stop, problem = yield from _member(a, at, path)
        else:
            one = _plain(w, at)
            stop, problem = (None, one) if isinstance(one, str) else (one[1], None)
            if problem is None:
                yield one[0] | {"path": path, "start": at, "stop": stop}
        if problem is None and bad is not None:
            yield _gap(path, bad, at, why)
        if problem is not None:
            if bad is None:
                bad, why = at, problem
            found = w.find(BEGIN, at + 1, cut=True)
            at = w.start + found.start() if found else a.size
            continue
        at, bad = stop, None
        if not w.start <= at <= w.stop:
            w = a.window(at)
    if bad is not None:
        yield _gap(path, bad, a.size, why)


def _gap(path: str, start: int, stop: int, why: str, inner: tuple[int, int] = (None, None)) -> dict:
    return {"path": path, "start": start, "stop": stop, "problem": why, "inner_start": inner[0], "inner_stop": inner[1]}


def _inflate(a: Archive, at: int):
    """The window of the member at ``at`` and a function that tells where it ends and what is wrong with it."""
    unpack, pos, wrong = zlib.decompressobj(31), at, None

    def more() -> bytes:
        nonlocal pos, wrong
        while not unpack.eof and wrong is None:
            data = unpack.unconsumed_tail or a.read(pos, STEP)
            if not unpack.unconsumed_tail:
                pos += len(data)
            if not data:
                wrong = "gzip: truncated member"
                break
            before = unpack.copy()
            try:
                out = unpack.decompress(data, 1 << 20)
            except zlib.error as e:
                wrong, out = f"gzip: {e}", _up_to_error(before, data)
            if out:
                return out
        return b""

    return Window(more), lambda: (pos - len(unpack.unused_data), wrong)


def _up_to_error(unpack, data: bytes) -> bytes:
    """What can be inflated before the byte that fails: in small steps, then byte by byte."""
    out, at, step = [], 0, 256
    while at < len(data):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            if step == 1:
                break
            unpack, step = before, 1
    return b"".join(out)


def _problem(a: Archive, at: int) -> str | None:
    """What is wrong with the member at ``at``, found by inflating it to its end."""
    body, end = _inflate(a, at)
    while body.has(body.stop + 1):
        body.cut(body.stop)
    return end()[1]


def _trusted(rows: list[tuple[dict, bool]], wrong: str | None) -> list[dict]:
    """The records to keep: all of a sound or truncated member, else those whose digest holds."""
    whole = wrong is None or "truncated" in wrong
    return [r for r, checked in rows if whole or checked]


def _member(a: Archive, at: int, path: str):
    """Rows of the gzip member at ``at``; returns where it ends, and what is wrong if it is broken."""
    body, end = _inflate(a, at)
    lo, gap, why, size, some = 0, None, "", 0, False
    held: list[tuple[dict, bool]] = []
    gaps: list[tuple[int, int, str]] = []
    told, wrong = False, None
    while body.has(lo + 1):
        body.cut(lo)
        one = _plain(body, lo)
        if isinstance(one, str):
            if gap is None:
                gap, why = lo, one
            found = body.find(VERSION, lo + 1, cut=True)
            lo = body.start + found.start() if found else body.stop
            continue
        if gap is not None:
            gaps.append((gap, lo, why))
            gap = None
        row, lo, checked = one
        some = True
        held.append((row | {"path": path, "start": at}, checked))
        size += len(row["payload"] or b"")
        if size > HOLD and not told:
            told, wrong = True, _problem(a, at)
        if told:
            yield from _trusted(held, wrong)
            held = []
    stop, wrong = end()
    if gap is not None:
        gaps.append((gap, body.stop, why))
    if wrong is None and not some and not gaps:
        wrong = "gzip: empty member"
    for r in _trusted(held, wrong):
        yield r | {"stop": stop if wrong is None else None}
    if wrong is None:
        for x, y, problem in gaps:
            yield _gap(path, at, stop, problem, (x, y))
    return stop, wrong


def _plain(w: Window, at: int):
    """The record whose version line is at ``at``, where it ends and whether a digest held; or what is wrong."""
    line = VERSION.match(w.get(at, at + 10))
    if not line:
        return "no version line"
    blank = w.find(BLANK, at, HEADER_MOST)
    if not blank:
        return "header without end"
    start = w.start + blank.end()
    fields: dict[str, str] = {}
    key = None
    for row in re.split(rb"\r?\n", w.get(at + line.end(), start - len(blank[0]))):
        if row[:1] in (b" ", b"\t") and key:
            fields[key] += " " + row.strip().decode("utf-8", "replace")
            continue
        name, colon, value = row.partition(b":")
        if not colon:
            return "header line without colon"
        key = name.strip().lower().decode("latin-1")
        fields[key] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit():
        return "no content length"
    if int(length) > RECORD_MOST:
        return f"block over {RECORD_MOST} bytes"
    stop = start + int(length)
    if not w.has(stop):
        return "block shorter than its length"
    if w.get(stop, stop + 4) != b"\r\n\r\n":
        return "record without end"
    block = w.get(start, stop)
    whole = _holds(fields.get("warc-block-digest"), block)
    if whole is False:
        return "block digest differs"
    kind = fields.get("warc-type", "")
    head, _, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http"):
        head, payload = b"", block
    digest = fields.get("warc-payload-digest")
    part = None if kind == "revisit" else _holds(digest, payload)
    if kind == "response" and part is False:
        return "payload digest differs"
    size = len(payload)
    if kind == "revisit":
        told = re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)
        size = int(told[1]) if told else None
    one = {"record_type": kind, "record_id": _bare(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": _bare(fields.get("warc-refers-to")), "payload_digest": _hex(digest) if kind == "revisit" else hashlib.sha1(payload).hexdigest(), "payload_bytes": size, "payload": None if kind == "revisit" else payload}
    return one, stop + 4, bool(whole or (part and kind == "response"))


def _parsed(said: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value (empty if malformed) of a digest field; None without a field or if the algorithm isn't known."""
    name, colon, value = (said or "").partition(":")
    name, value = (name.strip().lower().replace("-", ""), value.strip()) if colon else ("sha1", name.strip())
    if not said or (name not in DIGESTS and name.isalnum()):
        return None
    n = hashlib.new(name).digest_size if name in DIGESTS else 0
    try:
        got = bytes.fromhex(value) if len(value) == 2 * n else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        got = b""
    return name, got if len(got) == n else b""


def _holds(said: str | None, data: bytes) -> bool | None:
    """Whether a digest field is that of ``data``; None if there is none or its algorithm isn't known."""
    found = _parsed(said)
    return None if found is None else bool(found[1]) and hashlib.new(found[0], data).digest() == found[1]


def _hex(said: str | None) -> str | None:
    """A digest as bare lower-case hexadecimal if it is SHA-1, else as it is."""
    found = _parsed(said)
    return found[1].hex() if found and found[0] == "sha1" and found[1] else said


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read(spark: SparkSession, archives: str | DataFrame) -> DataFrame:
    """Records and gaps of archives; a gap has no record_type but a ``problem``.

    ``archives`` is a folder, or a table with a column ``path``, such as ``write``
    returns: files that an earlier try of a task left behind are then not read. Each
    archive is streamed by one task. Damaged ones lose the records of their gaps only.
    No archives give no rows, an empty archive neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_whole(path) as (file, length):
                    rows, size = [], 0
                    for r in salvage(file, path, length):
                        rows.append(r)
                        size += len(r.get("payload") or b"") + 1000
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    if isinstance(archives, str):
        fs, at = filesystem(spark, archives)
        if not fs.exists(at):
            return spark.createDataFrame([], SCHEMA)
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(archives)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks).mapInArrow(run, SCHEMA)


def read_logged(spark: SparkSession, archives: str | DataFrame, log: str, payload: bool = True) -> DataFrame:
    """The good records of ``archives``; the gaps are appended to the JSON lines of ``log``."""
    rows = read(spark, archives)
    rows = materialize(rows if payload else rows.drop("payload"), "salvaged")
    gaps = rows.where(F.col("problem").isNotNull())
    gaps.select("path", "start", "stop", "inner_start", "inner_stop", "problem").write.mode("append").json(log)
    return rows.where(F.col("record_type").isNotNull()).drop("inner_start", "inner_stop", "problem")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in _FIELDS], names=[n for n, _ in _FIELDS])


def query(spark, sf_dir):
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    records = read_logged(spark, archives, new_path(spark, "warc-gaps"), payload=False)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM h
"""
