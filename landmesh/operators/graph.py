"""Conductance graphs of rasters as edge relations, and what solvers leave on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .cells import neighbours
from .shared import ensure_checkpoints

#: More columns than any raster has: a node is its row times this, plus its column.
WIDTH = 1_000_000


def edges(surface: DataFrame, resistance: str, *keys: str, four: bool = False, mean_resistance: bool = False) -> DataFrame:
    """One row per pair of adjacent valid cells: places, conductance g. Diagonals are longer by the root of two.

    ``surface`` holds valid cells only; a resistance that is not positive and finite fails the query.
    """
    bad = F.col(resistance).isNull() | F.isnan(resistance) | (F.col(resistance) <= 0) | (F.col(resistance) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("resistance must be finite and positive"))).otherwise(F.col(resistance).cast("double"))
    pairs = neighbours(surface.withColumn("_r", checked), "_r", four, *keys)
    g = 1.0 / ((F.col("va") + F.col("vb")) / 2) if mean_resistance else (1.0 / F.col("va") + 1.0 / F.col("vb")) / 2
    return pairs.select(*(keys or ("sid",)), "r", "c", "r2", "c2", F.when(F.col("diagonal"), g / F.sqrt(F.lit(2.0))).otherwise(g).alias("g"))


def both_ways(e: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("sid",)
    back = e.select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"), "g")
    return e.select(*keys, "r", "c", "r2", "c2", "g").unionByName(back)


def degree(e: DataFrame, *keys: str) -> DataFrame:
    """Neighbours and summed conductance of each node."""
    return both_ways(e, *keys).groupBy(*(keys or ("sid",)), "r", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("degree"))


def flows(e: DataFrame, cells: DataFrame, voltage: str, *keys: str) -> DataFrame:
    """Current along every edge in both directions: g * (v - v2)."""
    keys = keys or ("sid",)
    a = cells.select(*keys, "r", "c", F.col(voltage).alias("_va"))
    b = cells.select(*keys, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col(voltage).alias("_vb"))
    f = both_ways(e, *keys).join(a, [*keys, "r", "c"]).join(b, [*keys, "r2", "c2"])
    return f.withColumn("i", F.col("g") * (F.col("_va") - F.col("_vb")))


def node_current(f: DataFrame, *keys: str) -> DataFrame:
    """The larger of what flows in and what flows out."""
    zero = F.lit(0.0)
    g = f.groupBy(*(keys or ("sid",)), "r", "c").agg(F.sum(F.greatest("i", zero)).alias("o"), F.sum(F.greatest(-F.col("i"), zero)).alias("n"))
    return g.select(*(keys or ("sid",)), "r", "c", F.greatest("o", "n").alias("current"))


def residual(f: DataFrame, cells: DataFrame, injection: str, grounded: str | None = None, supernode: str | None = None, *keys: str) -> DataFrame:
    """Relative residual of L v = b per raster; grounded rows are left out, a supernode's rows count as one."""
    keys = keys or ("sid",)
    lv = f.groupBy(*keys, "r", "c").agg(F.sum("i").alias("_lv"))
    t = cells.join(lv, [*keys, "r", "c"], "left").withColumn("_b", F.col(injection)).withColumn("_d", F.coalesce("_lv", F.lit(0.0)) - F.col(injection))
    if grounded:
        t = t.where(~F.col(grounded))
    group = F.when(F.col(supernode), F.lit(-1)).otherwise(F.col("r") * 100000 + F.col("c")) if supernode else F.col("r") * 100000 + F.col("c")
    t = t.groupBy(*keys, group.alias("_g")).agg(F.sum("_d").alias("_d"), F.sum("_b").alias("_b"))
    s = t.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("_e"), F.sqrt(F.sum(F.col("_b") * F.col("_b"))).alias("_n"))
    return s.select(*keys, F.when(F.col("_n") > 0, F.col("_e") / F.col("_n")).alias("residual"))


def component_labels(cells: DataFrame, *keys: str, four: bool = False, band: int = 1024) -> DataFrame:
    """Component of each valid cell, 0 the largest, ties to the smaller first cell; and the component's size.

    Bands of ``band`` rows are labelled by themselves, one task each. What remains is a
    graph of the bands' components that touch across a border; it is empty for rasters
    of one band, and its labels are lowered over its edges and jumped through each
    other until nothing changes. Works on rasters of any size; a label's cells are never
    shuffled together before the sizes are summed.
    """
    keys = keys or ("sid",)
    ensure_checkpoints(cells.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r0 = int(pdf.r.min())
        on = np.zeros((int(pdf.r.max()) - r0 + 1, int(pdf.c.max()) + 1), bool)
        on[pdf.r - r0, pdf.c] = True
        lab = K.labels(on, four)
        r, c = np.nonzero(on)
        _, first, of = np.unique(lab[on], return_index=True, return_inverse=True)
        out = pd.DataFrame({"r": r + r0, "c": c, "root": ((r + r0) * WIDTH + c)[first][of]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    local = cells.select(*keys, "r", "c").groupBy(*keys, F.floor(F.col("r") / band)).applyInPandas(label, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", r bigint, c bigint, root bigint").checkpoint()
    edge = local.where((F.col("r") % band).isin(0, band - 1))
    met = neighbours(edge, "root", four, *keys).where(F.floor(F.col("r") / band) != F.floor(F.col("r2") / band))
    links = met.select(*keys, F.col("va").alias("a"), F.col("vb").alias("b")).distinct().checkpoint()
    if links.isEmpty():
        labelled = local.withColumnRenamed("root", "m")
    else:
        lowest = _lowered(links, keys)
        labelled = local.join(lowest, [*keys, "root"], "left").select(*keys, "r", "c", F.coalesce("m", "root").alias("m"))
    sizes = labelled.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "m")) - 1
    return labelled.join(sizes.withColumn("label", place.cast("int")), [*keys, "m"]).select(*keys, "r", "c", "label", "size")


def _lowered(links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The smallest node that each node of ``links`` (a, b) reaches: root and m."""
    e = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    state = e.select(*keys, F.col("a").alias("v")).distinct().withColumn("m", F.col("v")).checkpoint()
    while True:
        near = e.join(state.select(*keys, F.col("v").alias("b"), F.col("m").alias("_n")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("v")).agg(F.min("_n").alias("_n"))
        low = state.join(near, [*keys, "v"]).select(*keys, "v", F.col("m").alias("_old"), F.least("m", "_n").alias("m"))
        jump = low.select(*keys, F.col("v").alias("m"), F.col("m").alias("_j"))
        new = low.join(jump, [*keys, "m"]).select(*keys, "v", F.least("m", "_j").alias("m"), "_old").checkpoint()
        if new.where("m <> _old").isEmpty():
            return new.select(*keys, F.col("v").alias("root"), "m")
        state = new.select(*keys, "v", "m")
