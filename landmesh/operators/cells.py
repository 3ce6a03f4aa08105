"""Operators on raster cells: stencils, rescaling, transforms, classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

#: Neighbour offsets east, south, south-east, south-west; the first two are cardinal.
OFFSETS = [(0, 1, False), (1, 0, False), (1, 1, True), (1, -1, True)]


def per_raster(*keys: str):
    return Window.partitionBy(*(keys or ("sid",)))


def rescale(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """Min-max to [0, 1] per raster; a constant raster becomes 0."""
    w = per_raster(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def field_to_resistance(field: Column, contrast: float, mapping: str = "log") -> Column:
    """A cost field in [0, 1] as resistance from 1 to ``contrast``."""
    if contrast < 1:
        raise ValueError("contrast must be at least 1")
    f = F.least(F.greatest(field, F.lit(0.0)), F.lit(1.0))
    if mapping == "log":
        r = F.pow(F.lit(float(contrast)), f)
    elif mapping == "linear":
        r = 1 + (contrast - 1) * f
    else:
        raise ValueError(f"unknown mapping {mapping}")
    return F.least(F.greatest(r, F.lit(1.0)), F.lit(float(contrast)))


def log_transform(df: DataFrame, value: str, out: str, *keys: str, eps: float = K.EPS) -> DataFrame:
    """log10(C + eps * max C) per map, C not below 0; a map of zeros stays 0."""
    c = F.greatest(F.col(value), F.lit(0.0))
    top = F.max(c).over(per_raster(*keys))
    return df.withColumn(out, F.when(top <= 0, F.lit(0.0)).otherwise(F.log10(c + eps * F.greatest(top, F.lit(1e-300)))))


def inverse_transform(y: Column, top: Column, eps: float = K.EPS) -> Column:
    return F.pow(F.lit(10.0), y) - eps * top


def gradient(df: DataFrame, value: str, pixel: float, *keys: str) -> DataFrame:
    """gy and gx: central differences, one-sided at the border."""
    for name, line, along in (("gy", "c", "r"), ("gx", "r", "c")):
        w = Window.partitionBy(*(keys or ("sid",)), line).orderBy(along)
        a, b = F.lag(value).over(w), F.lead(value).over(w)
        span = F.when(a.isNotNull() & b.isNotNull(), F.lit(2.0)).otherwise(F.lit(1.0))
        df = df.withColumn(name, (F.coalesce(b, F.col(value)) - F.coalesce(a, F.col(value))) / (span * pixel))
    return df


def slope_degrees(df: DataFrame, value: str, pixel: float, *keys: str) -> DataFrame:
    """Slope from elevation; gaps take the raster's mean for the differences and stay null."""
    mean = F.avg(value).over(per_raster(*keys))
    filled = df.withColumn("_e", F.coalesce(F.col(value).cast("double"), mean, F.lit(0.0)))
    s = gradient(filled, "_e", pixel, *keys)
    return s.withColumn("slope_deg", F.when(F.col(value).isNotNull(), F.degrees(F.atan(F.hypot("gx", "gy"))))).drop("_e")


def quantile_edges(df: DataFrame, value: str, shares: list[float], *keys: str) -> DataFrame:
    """Exact linear quantiles per raster as an array ``edges``."""
    return df.groupBy(*(keys or ("sid",))).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("edges"))


def digitize(df: DataFrame, value: str, classes: int, *keys: str) -> DataFrame:
    """Class from 0: the number of inner quantile edges that the value reaches."""
    edges = quantile_edges(df, value, [k / classes for k in range(1, classes)], *keys)
    out = df.join(edges, list(keys or ("sid",)))
    return out.withColumn("cls", F.size(F.filter("edges", lambda e: e <= F.col(value)))).drop("edges")


def neighbours(df: DataFrame, value: str, four: bool = False, *keys: str) -> DataFrame:
    """Each pair of adjacent valid cells once: both places and values, and whether it is diagonal.

    Every cell looks up to four neighbours by key, so the join is an equi-join on
    raster, row and column and never compares all cells of a raster.
    """
    keys = keys or ("sid",)
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(dg).alias("diagonal")) for dr, dc, dg in OFFSETS[: 2 if four else 4]])
    a = df.select(*keys, "r", "c", F.col(value).alias("va"), F.explode(offsets).alias("o"))
    a = a.select(*keys, "r", "c", "va", (F.col("r") + F.col("o.dr")).alias("r2"), (F.col("c") + F.col("o.dc")).alias("c2"), "o.diagonal")
    b = df.select(*keys, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col(value).alias("vb"))
    return a.join(b, [*keys, "r2", "c2"])


def merge_sources(cells: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Of several sources of a cell, the value of the last one that has any."""
    known = F.col(value).isNotNull()
    return cells.groupBy(*keys).agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias(value))


def nearest_feature(cells: DataFrame, features: DataFrame, attribute: str, pixel: float, side: int, *keys: str) -> DataFrame:
    """Distance to the nearest feature cell and its attribute; without features 10 extents and 0.

    Two exact one-dimensional passes instead of all pairs: first the nearest feature
    of each column above and below, then along blocks of rows the best column, outward
    from each cell until no farther column can be nearer. Ties go to the smaller row,
    then column. A block of rows is one task.
    """
    keys = keys or ("sid",)
    marked = cells.join(features.select(*keys, "r", "c", F.col(attribute).alias("_v")), [*keys, "r", "c"], "left")
    hit = F.when(F.col("_v").isNotNull(), F.struct("r", "_v"))
    w = Window.partitionBy(*keys, "c").orderBy("r")
    up = F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    lines = marked.withColumn("_u", up).withColumn("_d", down)
    du, dd = F.col("r") - F.col("_u.r"), F.col("_d.r") - F.col("r")
    take_up = F.col("_u").isNotNull() & (F.col("_d").isNull() | (du <= dd))
    lines = lines.withColumn("_b", F.when(take_up, F.col("_u")).otherwise(F.col("_d")))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    found = lines.where(F.col("_b").isNotNull()).select(*keys, "r", "c", F.col("_b.r").alias("fr"), F.col("_b._v").alias("v"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "r bigint", "c bigint", "_d2 bigint", "_fr bigint", "_fc bigint"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _nearest_columns(pdf.r.to_numpy(), pdf.c.to_numpy(), pdf.fr.to_numpy(), side)
        out = pd.DataFrame(dict(zip(("r", "c", "_d2", "_fr", "_fc"), out, strict=True)))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    near = found.drop("v").groupBy(*keys, F.floor(F.col("r") / ROWS)).applyInPandas(best, schema)
    near = near.join(found.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_fc"), F.col("v").alias("_v")).withColumnRenamed("_r", "r"), [*keys, "r", "_fc"])
    out = cells.join(near, [*keys, "r", "c"], "left")
    return out.withColumn("distance", F.coalesce(F.sqrt(F.col("_d2").cast("double")) * pixel, F.lit(10.0 * side * pixel))).withColumn("nearest", F.coalesce("_v", F.lit(0))).drop("_d2", "_fr", "_fc", "_v")


#: Rows of a raster that one task searches along.
ROWS = 64


def _nearest_columns(r: np.ndarray, c: np.ndarray, fr: np.ndarray, side: int):
    """Of rows whose cells know the nearest feature of their own column (fr): the nearest of all, for every column.

    One number orders squared distance, feature row and feature column. Columns are tried
    by rising distance, all cells in step, until the distance alone exceeds every best.
    """
    rows, at = np.unique(r, return_inverse=True)
    w = max(side, int(c.max()) + 1)
    top = np.iinfo(np.int64).max
    d2, feature = np.full((len(rows), w), top >> 2), np.zeros((len(rows), w), np.int64)
    d2[at, c], feature[at, c] = (r - fr) ** 2, fr
    span = int(feature.max()) + 1
    tail = feature * w + np.arange(w)
    have = d2 < top >> 2
    best = np.where(have, d2 * (span * w) + tail, top)
    for k in range(1, w):
        if k * k > (best.max() // (span * w) if (best < top).all() else top):
            break
        for to, of in ((slice(0, w - k), slice(k, w)), (slice(k, w), slice(0, w - k))):
            key = np.where(have[:, of], (d2[:, of] + k * k) * (span * w) + tail[:, of], top)
            best[:, to] = np.minimum(best[:, to], key)
    rr, cc = (x.ravel() for x in np.meshgrid(rows, np.arange(w), indexing="ij"))
    best = best.ravel()
    return rr, cc, best // (span * w), best % (span * w) // w, best % w
