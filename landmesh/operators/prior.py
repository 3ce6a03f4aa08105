"""Synthetic landscapes drawn from a prior: parameters first, then the landscape from them.

``draw`` turns a seed into a tree of parameters, ``build`` turns parameters and the same
seed into rasters; neither needs the other's random numbers, so a stored landscape can be
made again from what was stored, and checked against the prior.
"""

from __future__ import annotations

import math

import numpy as np

from .. import constants as C
from . import kernels as K


def stream(seed: int, *names: str) -> np.random.Generator:
    """An independent generator for each seed and name; global random state is never touched."""
    key = [int.from_bytes(n.encode()[:8].ljust(8, b"\0"), "little") for n in names]
    return np.random.default_rng(np.random.SeedSequence([int(seed) & (2**63 - 1), *key]))


def checked(shape) -> tuple[int, int]:
    h, w = (int(x) for x in shape)
    if min(h, w) < 4:
        raise ValueError("fields need at least 4 by 4 cells")
    return h, w


def _pick(rng: np.random.Generator, values, weights=None):
    p = None if weights is None else np.asarray(weights, float) / np.sum(weights)
    return values[int(rng.choice(len(values), p=p))]


def _between(rng: np.random.Generator, bounds, whole: bool = False):
    return int(rng.integers(bounds[0], bounds[1] + 1)) if whole else float(rng.uniform(*bounds))


#: How each generator's parameters are drawn: one of several, a real number, or a whole one.
_DRAWS = {"length_scale": "pick", "roughness": "pick", "anisotropy": "real", "angle_deg": "real", "p": "real", "direction_deg": "real", "n_sources": "whole", "n_elements": "whole"}


def draw(seed: int, shape, prior: dict | None = None) -> dict:
    """Parameters of a landscape: generator, overlays, no-data blobs, contrast and mapping."""
    prior, (h, w), rng = prior or C.PRIOR, checked(shape), stream(seed, "draw")
    name = _pick(rng, list(prior["generator_weights"]), list(prior["generator_weights"].values()))
    base = {k: _pick(rng, v) if _DRAWS[k] == "pick" else _between(rng, v, _DRAWS[k] == "whole") for k, v in prior[name].items()}
    out: dict = {"shape": [h, w], "generator": name, "base": base}
    if rng.random() < prior["p_patch_mosaic"]:
        out["patch_mosaic"] = {"n_classes": _between(rng, prior["patch_classes"], True)}
    if rng.random() < prior["p_barriers"]:
        b = prior["barriers"]
        lines = _between(rng, b["n_lines_per_128px"], True) * math.sqrt(h * w) / 128
        out["barriers"] = {"n_lines": max(1, round(lines)), **{k: _between(rng, b[k]) for k in ("width_px", "gap_fraction", "gap_length_px", "barrier_cost")}}
        out["barriers"]["orientation_deg"] = _between(rng, (0.0, 180.0)) if rng.random() < b["p_oriented"] else None
    if rng.random() < prior["p_nodata"]:
        out["nodata"] = {k: _between(rng, prior["nodata"][k]) for k in ("fraction", "length_scale")}
    out["contrast"] = _pick(rng, prior["contrast"], prior["contrast_weights"])
    out["mapping"] = prior["mapping"]
    return out


def barrier_mask(shape, n_lines: int, width_px: float, rng: np.random.Generator, orientation_deg: float | None = None, gap_fraction: float = 0.0, gap_length_px: float = 4.0) -> np.ndarray:
    """Cells within half a width of random lines, open at regular gaps that make up ``gap_fraction`` of a line."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, bool)
    for _ in range(n_lines):
        r0, c0, shift = rng.uniform(0, shape[0]), rng.uniform(0, shape[1]), rng.uniform(0, 1)
        turn = math.radians(rng.uniform(0, 180) if orientation_deg is None else orientation_deg)
        along = (x - c0) * math.cos(turn) + (y - r0) * math.sin(turn)
        line = np.abs((y - r0) * math.cos(turn) - (x - c0) * math.sin(turn)) <= max(width_px, 1) / 2
        if gap_fraction > 0:
            period = gap_length_px / gap_fraction
            line &= (along / period + shift) % 1 >= gap_fraction
        out |= line
    return out


def patch_values(field: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Quantile classes of a field with random values, one of them 0 and one 1."""
    values = rng.random(n)
    low, high = rng.permutation(n)[:2]
    values[low], values[high] = 0.0, 1.0
    return values[np.searchsorted(np.quantile(field, np.arange(1, n) / n), field, "right")]


def nodata_blobs(shape, fraction: float, length_scale: float, rng: np.random.Generator) -> np.ndarray:
    """True where there is no data: a field's lowest share, and all valid cells outside the largest component."""
    if not 0 <= fraction < 0.5:
        raise ValueError("fraction must be in [0, 0.5)")
    if fraction == 0:
        return np.zeros(shape, bool)
    field = K.gaussian_field(shape, length_scale, rng)
    return K.labels(field >= np.quantile(field, fraction)) != 0


def build(params: dict, seed: int) -> dict:
    """The landscape of given parameters: cost field, resistance (1 where there is no data) and nodata."""
    shape = checked(params["shape"])
    field = K.field(params["generator"], shape, stream(seed, "base"), **params["base"])
    if "patch_mosaic" in params:
        field = patch_values(field, params["patch_mosaic"]["n_classes"], stream(seed, "patches"))
    if "barriers" in params:
        b = dict(params["barriers"])
        cost = b.pop("barrier_cost")
        field = np.where(barrier_mask(shape, rng=stream(seed, "barriers"), **b), np.maximum(field, cost), field)
    nodata = nodata_blobs(shape, rng=stream(seed, "nodata"), **params["nodata"]) if "nodata" in params else np.zeros(shape, bool)
    top = float(params["contrast"])
    resistance = top**field if params["mapping"] == "log" else 1 + (top - 1) * field
    resistance = np.where(nodata, 1.0, np.clip(resistance, 1.0, top)).astype(np.float32)
    return {"generator": params["generator"], "contrast": top, "cost": field, "resistance": resistance, "valid": ~nodata, "params": params}


def landscape(seed: int, shape, prior: dict | None = None) -> dict:
    return build(draw(seed, shape, prior), seed)


def regenerated(params: dict, seed: int, prior: dict | None = None) -> dict:
    """A stored landscape made again; an error if the prior no longer gives its parameters."""
    if draw(seed, params["shape"], prior) != params:
        raise RuntimeError("the prior gives other parameters for this seed")
    return build(params, seed)
