"""A table of immutable shards under a versioned manifest, compacted by size tiers."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import filesystem, new_path


@dataclass(frozen=True)
class Run:
    """What one append or merge wrote: a folder of immutable Parquet shards."""

    name: str
    size: int
    rows: int
    files: int


@dataclass(frozen=True)
class Manifest:
    """One version of the table: the runs that make it up, and the columns of the first append (JSON)."""

    version: int = 0
    runs: tuple[Run, ...] = field(default=())
    schema: str | None = None


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@contextmanager
def _read_by_bytes(spark: SparkSession, parts: int, size: int) -> Iterator[None]:
    """Scans planned inside deal their files to about ``parts`` tasks of up to ``size`` bytes, whatever the number of files."""
    keys = {"spark.sql.files.minPartitionNum": str(parts), "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ShardedTable:
    """Append-only table at ``root`` on any file system that Hadoop reaches.

    A version is one small file, ``manifest/NNNNNNNNNN.json``, that appears by an atomic
    rename and is never changed; readers take the highest. Its size follows the number of
    runs, which tiers keep logarithmic in the data, not the number of shards. Rows move
    through Spark alone; the driver handles names and sizes.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, base_bytes: int = 4 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.base, self.fanout = target_bytes, base_bytes, fanout
        self.fs, at = filesystem(spark, self.root)
        self.root = self.fs.makeQualified(at).toString()

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    # -- versions ---------------------------------------------------------------

    def manifest(self, version: int | None = None) -> Manifest:
        """The highest version, or the one asked for; an unused table has version 0 and no runs."""
        if version is None:
            at = self._path("manifest")
            names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
            version = max([int(n[:10]) for n in names if n.endswith(".json")], default=0)
        if version == 0:
            return Manifest()
        stream = self.fs.open(self._path("manifest", f"{version:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(found["version"], tuple(Run(**r) for r in found["runs"]), found["schema"])

    def _commit(self, old: Manifest, runs: tuple[Run, ...], schema: str | None = None) -> Manifest:
        new = Manifest(old.version + 1, runs, old.schema or schema)
        self.fs.mkdirs(self._path("manifest"))
        draft, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"{new.version:010d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        # This rename, unlike FileSystem's, never replaces a file that is there.
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.fs.getConf()).rename(draft, final, options)
        except Exception as e:
            self.fs.delete(draft, False)
            raise Conflict(f"version {new.version} exists") from e
        return new

    # -- writing ----------------------------------------------------------------

    def _run(self, name: str, rows: int) -> Run:
        shards = [x.getLen() for x in self.fs.listStatus(self._path("runs", name)) if x.getPath().getName().startswith("part-")]
        return Run(name, sum(shards), rows, len(shards))

    def _write(self, df: DataFrame, rows: int | None = None) -> Run:
        name = uuid.uuid4().hex
        path = "/".join((self.root, "runs", name))
        df.write.option("compression", "zstd").parquet(path)
        return self._run(name, self.spark.read.parquet(path).count() if rows is None else rows)

    def _publish(self, change, written: Run | None, schema: str | None = None, tries: int = 20) -> Manifest | None:
        """Commit ``change(manifest)``, a new list of runs; another writer's commit makes it look again.

        If the change is not possible any more (None) or every try meets a conflict, the
        run that was written for it is deleted.
        """
        for _ in range(tries):
            now = self.manifest()
            runs = change(now)
            if runs is None:
                break
            try:
                return self._commit(now, runs, schema)
            except Conflict:
                continue
        if written:
            self.fs.delete(self._path("runs", written.name), True)
        if runs is not None:
            raise Conflict(f"{tries} versions appeared meanwhile")
        return None

    def append(self, df: DataFrame) -> Manifest:
        """Add the rows of ``df`` as one run of small shards; no rows add no version, but for the table's first."""
        return self._append(self._write(df), df.schema.json())

    def _append(self, run: Run, schema: str) -> Manifest:
        if not run.rows:
            self.fs.delete(self._path("runs", run.name), True)
            now = self.manifest()
            return now if now.version else self._publish(lambda m: m.runs, None, schema)
        return self._publish(lambda m: (*m.runs, run), run, schema)

    def append_parts(self, df: DataFrame, part: Column) -> Iterator[Manifest]:
        """Add the rows of ``df`` as one run for each value of ``part``, in its order: one pass writes them all."""
        draft = uuid.uuid4().hex
        path = "/".join((self.root, "drafts", draft))
        df.withColumn("__lm_part", part).write.option("compression", "zstd").partitionBy("__lm_part").parquet(path)
        schema = df.schema.json()
        rows = {r.p: r.n for r in self.spark.read.schema("__lm_part int").parquet(path).groupBy(F.col("__lm_part").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.fs.mkdirs(self._path("runs"))
        for p in sorted(rows):
            name = uuid.uuid4().hex
            self.fs.rename(self._path("drafts", draft, f"__lm_part={p}"), self._path("runs", name))
            yield self._append(self._run(name, rows[p]), schema)
        if not rows:
            yield self._publish(lambda m: m.runs, None, schema) if not self.manifest().version else self.manifest()
        self.fs.delete(self._path("drafts", draft), True)

    def tier(self, run: Run) -> int:
        """0 below ``fanout`` times the base size, then one more for each factor of ``fanout``."""
        return max(0, math.floor(math.log(max(run.size, 1) / self.base, self.fanout))) if run.size > self.base else 0

    def due(self, manifest: Manifest) -> list[Run]:
        """The runs of the smallest tier that has ``fanout`` runs or more."""
        tiers: dict[int, list[Run]] = {}
        for r in manifest.runs:
            tiers.setdefault(self.tier(r), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> Manifest:
        """Merge similarly sized runs into files of the target size until no tier is full.

        A merge reads and writes its rows once and moves none between machines. The new
        run replaces the old ones in one commit; they stay on disk for older versions
        until ``vacuum``. A lost executor repeats its own files only, and a driver that
        is lost before the commit leaves the table as it was. Versions that others commit
        meanwhile are kept; a merge whose runs they took is dropped.
        """
        now = self.manifest()
        while merge := self.due(now):
            size, gone = sum(r.size for r in merge), {r.name for r in merge}
            files = max(1, round(size / self.target))
            with _read_by_bytes(self.spark, files, self.target):
                run = self._write(self._read(merge).coalesce(files), sum(r.rows for r in merge))
            self._publish(lambda m, gone=gone, run=run: (*(r for r in m.runs if r.name not in gone), run) if gone <= {r.name for r in m.runs} else None, run)
            now = self.manifest()
        return now

    def vacuum(self, keep: int = 2, grace_s: float = 3600.0) -> None:
        """Delete manifests but the last ``keep`` and all runs that these don't name.

        Readers of a kept version never lose a file; files younger than ``grace_s``
        seconds stay too, as they may belong to a write that is not committed yet.
        """
        last = self.manifest().version
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        names = {r.name for m in kept for r in m.runs}
        old = lambda s: s.getModificationTime() <= 1000 * (time.time() - grace_s)
        for s in self.fs.listStatus(self._path("runs")) if self.fs.exists(self._path("runs")) else []:
            if s.getPath().getName() not in names and old(s):
                self.fs.delete(s.getPath(), True)
        for s in self.fs.listStatus(self._path("manifest")) if last else []:
            name = s.getPath().getName()
            if name.endswith(".json") and int(name[:10]) <= last - keep and old(s):
                self.fs.delete(s.getPath(), False)

    # -- reading ----------------------------------------------------------------

    def _read(self, runs) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*["/".join((self.root, "runs", r.name)) for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; columns that only some runs have are null elsewhere.

        A version without runs gives no rows, with the columns of the first append. A
        table that nothing was ever appended to has no columns and raises ValueError.
        """
        found = self.manifest(version)
        if found.schema is None:
            raise ValueError("nothing was ever appended to the table")
        schema = T.StructType.fromJson(json.loads(found.schema))
        return self._read(found.runs) if found.runs else self.spark.createDataFrame([], schema)


def arrive(docs: DataFrame, root: str, arrivals: int = 6, **sizes) -> ShardedTable:
    """Append all of ``docs`` in ``arrivals`` parts by a hash of the row, compacting after each.

    ``docs`` is read once. The version before the last stays readable. Null ids, null
    texts, repeated rows and columns of any name travel as they are; no rows give a
    table without rows that has the columns of ``docs``.
    """
    table = ShardedTable(docs.sparkSession, root, **sizes)
    for _ in table.append_parts(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals)).cast("int")):
        table.compact()
        table.vacuum(keep=2, grace_s=0)
    return table


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = arrive(docs, new_path(spark, "shards"), target_bytes=32 << 20, base_bytes=1 << 20, fanout=3)
    return table.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
