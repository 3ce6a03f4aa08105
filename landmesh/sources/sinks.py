"""Texts and files made from tables: ASCII grids, array archives, schema pages, dataset cards, summaries."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's types as the vocabulary of dataset cards has them.
CARD_TYPES = {"string": "sc:Text", "boolean": "sc:Boolean", "tinyint": "sc:Integer", "smallint": "sc:Integer", "int": "sc:Integer", "bigint": "sc:Integer", "float": "sc:Float", "double": "sc:Float", "date": "sc:Date", "timestamp": "sc:DateTime", "timestamp_ntz": "sc:DateTime"}


def ascii_grids(cells: DataFrame, value: str, nodata: int = -9999, cellsize: int = 100) -> DataFrame:
    """One text per raster in the ESRI form: sid and grid. Null cells have the no-data value.

    A row is joined first, then the rows of a raster, so a task sorts one row of cells and
    then one text a row.
    """
    shown = F.coalesce(F.col(value).cast("string"), F.lit(str(nodata)))
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), sep)
    rows = cells.groupBy("sid", "r").agg(joined(F.collect_list(F.struct(F.col("c").alias("k"), shown.alias("t"))), " ").alias("t"), (F.max("c") + 1).alias("w"))
    grids = rows.groupBy("sid").agg(joined(F.collect_list(F.struct(F.col("r").alias("k"), "t")), "\n").alias("t"), F.max("w").alias("w"), (F.max("r") + 1).alias("h"))
    head = [F.lit("ncols "), F.col("w").cast("string"), F.lit("\nnrows "), F.col("h").cast("string"), F.lit(f"\nxllcorner 0\nyllcorner 0\ncellsize {cellsize}\nNODATA_value {nodata}\n")]
    return grids.select("sid", F.concat(*head, "t", F.lit("\n")).alias("grid"))


def write_ascii_grids(cells: DataFrame, value: str, folder: str) -> None:
    """A folder of texts, one file of one grid for each raster."""
    ascii_grids(cells, value).select(F.col("sid").cast("string").alias("sid"), F.col("grid").alias("value")).repartition("sid").write.partitionBy("sid").text(folder)


def array_archives(cells: DataFrame, *values: str) -> DataFrame:
    """Each raster's arrays as one NPZ file in a binary column, and their shape as JSON."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.r.max()) + 1, int(pdf.c.max()) + 1
        arrays = {}
        for name in values:
            arrays[name] = np.zeros((h, w), pdf[name].dtype)
            arrays[name][pdf.r, pdf.c] = pdf[name]
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        meta = json.dumps({"arrays": list(values), "h": h, "w": w}, sort_keys=True)
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "npz": [out.getvalue()], "meta": [meta]})

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, npz binary, meta string")


def read_archives(archives: DataFrame, value: str) -> DataFrame:
    """The cells of one array of each archive: sid, r, c and the value."""

    def run(batches):
        for pdf in batches:
            for sid, data in zip(pdf.sid, pdf.npz, strict=True):
                a = np.load(io.BytesIO(data))[value]
                r, c = np.mgrid[: a.shape[0], : a.shape[1]]
                yield pd.DataFrame({"sid": sid, "r": r.ravel(), "c": c.ravel(), value: a.ravel()})

    return archives.mapInPandas(run, f"sid bigint, r bigint, c bigint, {value} double")


def schema_page(name: str, schema: T.StructType, notes: dict[str, str] | None = None) -> str:
    """A schema as a Markdown page."""
    rows = [f"| `{f.name}` | {f.dataType.simpleString()} | {'optional' if f.nullable else 'required'} | {(notes or {}).get(f.name, '')} |" for f in schema]
    return "\n".join([f"# {name}", "", "| field | type | | note |", "|---|---|---|---|", *rows, ""])


def card(name: str, version: str, license_url: str, tables: dict[str, T.StructType], files: dict[str, str], notes: dict[str, str] | None = None) -> dict:
    """A Croissant description: one file set and one record set for each table.

    ``files`` has the place of each table below the dataset's root. Columns without a
    type of the vocabulary, nested ones, are described as text.
    """
    sets, records = [], []
    for table, schema in tables.items():
        sets.append({"@type": "cr:FileSet", "@id": f"files-{table}", "name": f"files-{table}", "encodingFormat": "application/x-parquet", "includes": files[table]})
        fields = [{"@type": "cr:Field", "@id": f"{table}/{f.name}", "name": f.name, "description": (notes or {}).get(f.name, f.name), "dataType": CARD_TYPES.get(f.dataType.simpleString(), "sc:Text"), "source": {"fileSet": {"@id": f"files-{table}"}, "extract": {"column": f.name}}} for f in schema]
        records.append({"@type": "cr:RecordSet", "@id": table, "name": table, "field": fields})
    context = {"@vocab": "https://schema.org/", "sc": "https://schema.org/", "cr": "http://mlcommons.org/croissant/", "dct": "http://purl.org/dc/terms/", "conformsTo": "dct:conformsTo"}
    return {"@context": context, "@type": "sc:Dataset", "conformsTo": "http://mlcommons.org/croissant/1.0", "name": name, "version": version, "license": license_url, "distribution": sets, "recordSet": records}


def markdown(df: DataFrame, *order: str) -> DataFrame:
    """The rows of a summary as lines of a Markdown table: no (from -2: head and rule) and line."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    heads = [(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + "---|" * len(df.columns))]
    rows = df.select(F.struct(*order).alias("_o"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("_o", "line"))).alias("l")).select(F.posexplode("l").alias("no", "x")).select("no", "x.line")
    return df.sparkSession.createDataFrame(heads, "no int, line string").unionByName(rows)


def located(spark, folder: str, pattern: str) -> list[str]:
    """Names of what lies in a folder and matches a glob, sorted; none if the folder is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getName() for s in found or [])


def null_for_nan(df: DataFrame) -> DataFrame:
    """Every floating column with null in place of NaN."""
    bare = lambda c, t: F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c)
    return df.select(*[bare(c, t) for c, t in df.dtypes])


def weighted_shards(rows: DataFrame, cost: Column, limit: int, group: list[str], order: list[str]) -> DataFrame:
    """Add ``shard``: within each group, runs of rows in order whose whole-number costs add up to ``limit``, about."""
    from pyspark.sql import Window

    upto = F.sum("_cost").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_cost", cost).withColumn("shard", F.floor((upto - F.col("_cost")) / limit)).drop("_cost")
