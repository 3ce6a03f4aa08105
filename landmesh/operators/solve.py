"""Solvers as grouped maps: one raster and configuration per call, any number at once."""

from __future__ import annotations

import json
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import prior as P

#: Rasters solved at once by ``moving_window``: neighbouring ids, their cells at most, and the radius up to which that pays.
TOGETHER, SMALL_CELLS, SMALL_RADIUS = 256, 1024, 5


def packed(cells: DataFrame, *values: str, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """One row per raster: the cells as arrays in row-major order."""
    items = F.array_sort(F.collect_list(F.struct("r", "c", *values)))
    return cells.groupBy(*keys).agg(items.alias("_cells")).select(*keys, *[F.col(f"_cells.{v}").alias(v) for v in ("r", "c", *values)])


def unpacked(rasters: DataFrame, *values: str, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    return rasters.select(*keys, F.inline(F.arrays_zip("r", "c", *values)))


def _grid(pdf: pd.DataFrame, *names: str) -> list[np.ndarray]:
    h, w = int(pdf.r.max()) + 1, int(pdf.c.max()) + 1
    out = []
    for name in names:
        a = np.zeros((h, w), pdf[name].dtype if pdf[name].dtype != object else float)
        a[pdf.r, pdf.c] = pdf[name]
        out.append(a)
    return out


def _long(sid, shape, **maps) -> pd.DataFrame:
    r, c = np.mgrid[: shape[0], : shape[1]]
    return pd.DataFrame({"sid": sid, "r": r.ravel(), "c": c.ravel(), **{k: np.asarray(v).ravel() for k, v in maps.items()}})


def pairwise(cells: DataFrame) -> DataFrame:
    """Effective resistance of all focal pairs (-1: not connected), worst residual and seconds.

    ``cells``: sid, r, c, resistance, valid, focal (0: none). The kernel picks its method
    by the raster's width; a raster on which that fails is left to conjugate gradients
    of the other kind, and only then says so.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        res, valid, focal = _grid(pdf, "resistance", "valid", "focal")
        began, fallback = time.monotonic(), False
        try:
            out = K.pairwise(res, valid, focal)
        except np.linalg.LinAlgError:
            out, fallback = _iterative(res, valid, focal), True
        ids, rows = out["labels"], []
        for a, i in enumerate(ids):
            for b in range(a + 1, len(ids)):
                rows.append((pdf.sid.iloc[0], i, ids[b], out["reff"][a, b], out["residual"], fallback, time.monotonic() - began))
        return pd.DataFrame(rows, columns=["sid", "i", "j", "reff", "residual", "fallback_used", "wall_s"])

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, i int, j int, reff double, residual double, fallback_used boolean, wall_s double")


def _iterative(res, valid, focal) -> dict:
    cond, lab = K.conductances(res, valid), K.labels(valid)
    ids = [int(x) for x in np.unique(focal[focal > 0])]
    reff, worst = np.zeros((len(ids), len(ids))), 0.0
    for a, i in enumerate(ids):
        for b in range(a + 1, len(ids)):
            gi, gj = (focal == i) & valid, (focal == ids[b]) & valid
            home = set(lab[gi | gj].tolist())
            if len(home) != 1:
                reff[a, b] = reff[b, a] = -1
                continue
            active = lab == min(home)
            v, _ = K.conjugate_gradient(cond, active, gj / gj.sum(), gi, (1e-10,))
            worst = max(worst, K.residual(cond, active, v, gj / gj.sum(), gi))
            reff[a, b] = reff[b, a] = v[gj].mean()
    return {"labels": ids, "reff": reff, "residual": worst}


def pair_maps(cells: DataFrame) -> DataFrame:
    """Voltage and current of every pair and cell: sid, i, j, r, c, voltage, current."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = K.pairwise(*_grid(pdf, "resistance", "valid", "focal"))
        parts = [_long(pdf.sid.iloc[0], v.shape, voltage=v, current=out["current"][p]).assign(i=p[0], j=p[1]) for p, v in out["voltage"].items()]
        cols = ["sid", "i", "j", "r", "c", "voltage", "current"]
        return pd.concat(parts)[cols] if parts else pd.DataFrame(columns=cols)

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, i int, j int, r bigint, c bigint, voltage double, current double")


def cumulative(cells: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = K.pairwise(*_grid(pdf, "resistance", "valid", "focal"))
        return _long(pdf.sid.iloc[0], out["cumulative"].shape, cum_current=out["cumulative"])

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, r bigint, c bigint, cum_current double")


def advanced(cells: DataFrame) -> DataFrame:
    """Voltage and current from ``source`` into ``ground`` cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = K.advanced(*_grid(pdf, "resistance", "valid", "source", "ground"))
        return _long(pdf.sid.iloc[0], out["voltage"].shape, voltage=out["voltage"], current=out["current"]).assign(residual=out["residual"])

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, r bigint, c bigint, voltage double, current double, residual double")


def moving_window(cells: DataFrame, radius: int, block: int = 1, threshold: float = 0.0, bands: int = 4) -> DataFrame:
    """Cumulative current, flow potential and their ratio, targets dealt over ``bands`` tasks per raster.

    Each task gets the rows that its targets' windows touch, so a raster of any height
    spreads over many tasks; partial maps add up by cell. Small rasters that every band
    would get as a whole are solved ``TOGETHER`` neighbouring ids at once instead.
    """
    margin = radius + block
    extent = cells.groupBy("sid").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    small = (F.col("_h") <= 2 * margin) & (F.col("_h") * F.col("_w") <= SMALL_CELLS) & F.lit(radius <= SMALL_RADIUS)
    step = F.when(small, F.col("_h")).otherwise(F.ceil(F.ceil(F.col("_h") / bands) / block) * block)
    t = cells.join(extent, "sid").withColumn("_small", small).withColumn("_s", step)
    low = F.greatest(F.floor((F.col("r") - margin) / F.col("_s")), F.lit(0))
    high = F.when(F.col("_small"), F.lit(0)).otherwise(F.floor((F.col("r") + margin) / F.col("_s")))
    t = t.withColumn("_band", F.explode(F.sequence(low, high))).where(F.col("_band") * F.col("_s") < F.col("_h"))
    t = t.withColumn("_group", F.when(F.col("_small"), F.floor(F.col("sid") / TOGETHER)).otherwise(F.col("sid")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf._small.iloc[0]:
            return pd.concat([together(x) for _, x in pdf.groupby(["_h", "_w"])])
        band, s, h, r0 = int(pdf._band.iloc[0]), int(pdf._s.iloc[0]), int(pdf._h.iloc[0]), int(pdf.r.min())
        shift = r0 % block
        local = pdf.assign(r=pdf.r - r0 + shift)
        res, valid, source = _grid(local, "resistance", "valid", "source")
        res = np.where(valid, res, 1.0)
        first, last = band * s - r0 + shift, min((band + 1) * s, h) - r0 + shift
        out = _windows(res, valid, source, radius, block, threshold, first, last)
        got = _long(pdf.sid.iloc[0], res.shape, cum=out["cumulative"], pot=out["potential"])
        got["r"] += r0 - shift
        return got[(got.cum != 0) | (got["pot"] != 0)]

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, k = np.unique(pdf.sid, return_inverse=True)
        shape = len(ids), int(pdf._h.iloc[0]), int(pdf._w.iloc[0])
        res, valid, source = np.ones(shape), np.zeros(shape, bool), np.zeros(shape)
        for grid, name in ((res, "resistance"), (valid, "valid"), (source, "source")):
            grid[k, pdf.r, pdf.c] = pdf[name]
        out = K.moving_windows(res, valid, source, radius, block, threshold)
        k, r, c = np.nonzero((out["cumulative"] != 0) | (out["potential"] != 0))
        return pd.DataFrame({"sid": ids[k], "r": r, "c": c, "cum": out["cumulative"][k, r, c], "pot": out["potential"][k, r, c]})

    part = t.groupBy("_small", "_group", "_band").applyInPandas(run, "sid bigint, r bigint, c bigint, cum double, pot double")
    total = part.groupBy("sid", "r", "c").agg(F.sum("cum").alias("cum_current"), F.sum("pot").alias("flow_potential"))
    out = cells.select("sid", "r", "c").join(total, ["sid", "r", "c"], "left").na.fill(0.0, ["cum_current", "flow_potential"])
    return out.withColumn("normalized", F.when(F.col("flow_potential") > 0, F.col("cum_current") / F.col("flow_potential")).otherwise(F.lit(0.0)))


def _windows(res, valid, source, radius, block, threshold, first, last) -> dict:
    """``moving_window`` for the targets of rows first to last only."""
    mask = np.zeros(valid.shape, bool)
    mask[max(0, first) : last] = True
    return K.moving_window(res, valid, source, radius, block, threshold, mask)


def convergence(cells: DataFrame, targets: tuple[float, ...] = (1e-4, 1e-6, 1e-10)) -> DataFrame:
    """Iterations of conjugate gradients to each residual target, for the first focal pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        res, valid, focal = _grid(pdf, "resistance", "valid", "focal")
        ids = np.unique(focal[focal > 0])
        ground, top = focal == ids[0], focal == ids[1]
        cond, lab = K.conductances(res, valid), K.labels(valid)
        active = lab == lab[ground][0]
        _, done = K.conjugate_gradient(cond, active, top / top.sum(), ground, targets)
        return pd.DataFrame([(pdf.sid.iloc[0], t, n) for t, n in done.items()], columns=["sid", "target", "iterations"])

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, target double, iterations int")


def landscapes(seeds: DataFrame, side: int = 32, prior: dict | None = None) -> DataFrame:
    """Synthetic landscapes from seeds (column ``seed``): sid, r, c, resistance, valid, generator, contrast."""

    def run(batches):
        for pdf in batches:
            for seed in pdf.seed:
                ls = P.landscape(int(seed), (side, side), prior)
                yield _long(int(seed), (side, side), resistance=ls["resistance"], valid=ls["valid"]).assign(generator=ls["generator"], contrast=ls["contrast"])

    return seeds.select("seed").mapInPandas(run, "sid bigint, r bigint, c bigint, resistance double, valid boolean, generator string, contrast double")


def parameters(seeds: DataFrame, side: int = 32, prior: dict | None = None) -> DataFrame:
    """What the prior draws for each seed: sid and its parameters as JSON."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"sid": pdf.seed, "params": [json.dumps(P.draw(int(x), (side, side), prior), sort_keys=True) for x in pdf.seed]})

    return seeds.select("seed").mapInPandas(run, "sid bigint, params string")


def regenerated(stored: DataFrame, prior: dict | None = None) -> DataFrame:
    """Landscapes made again from stored ``sid`` and ``params``; a row that the prior contradicts is an error."""

    def run(batches):
        for pdf in batches:
            for sid, params in zip(pdf.sid, pdf.params, strict=True):
                ls = P.regenerated(json.loads(params), int(sid), prior)
                yield _long(int(sid), ls["valid"].shape, resistance=ls["resistance"], valid=ls["valid"])

    return stored.select("sid", "params").mapInPandas(run, "sid bigint, r bigint, c bigint, resistance double, valid boolean")


def focal_points(cells: DataFrame, k: int = 3, separation: int = 8) -> DataFrame:
    """Seeded focal points in the largest component: sid, label, r, c."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        res, valid = _grid(pdf, "resistance", "valid")
        got = K.focal_points(res, valid, k, separation, np.random.default_rng(int(pdf.sid.iloc[0])))
        return pd.DataFrame([(pdf.sid.iloc[0], i + 1, r, c) for i, (r, c) in enumerate(got)], columns=["sid", "label", "r", "c"])

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, label int, r bigint, c bigint")


def outlines(cells: DataFrame) -> DataFrame:
    """WKT of each region: sid, label and polygon."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(pdf.r.max()) + 1, int(pdf.c.max()) + 1), bool)
        mask[pdf.r, pdf.c] = True
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "label": [pdf.label.iloc[0]], "wkt": [K.outline(mask)]})

    return cells.groupBy("sid", "label").applyInPandas(run, "sid bigint, label int, wkt string")


def perturbed_table(table: dict, seed: int, sd: float = 0.5) -> dict:
    """A log-normal jitter of land cover, roads and slope, in this order, within [1, r_max]."""
    rng = np.random.default_rng(seed)
    out = dict(table)
    top = table["r_max"]
    out["landcover"] = {k: float(np.clip(v * np.exp(rng.normal(0, sd)), 1, top)) for k, v in sorted(table["landcover"].items())}
    if "roads" in table:
        out["roads"] = {k: float(np.clip(v * np.exp(rng.normal(0, sd)), 0, top)) for k, v in sorted(table["roads"].items())}
    if "slope" in table:
        per, cap = table["slope"]
        out["slope"] = (float(per * np.exp(rng.normal(0, sd))), cap)
    return out
