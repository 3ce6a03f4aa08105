"""Configurations in YAML: resistance tables, source configurations, solver presets and profiles.

Files are small and read on the driver; what they hold becomes literals of a plan. Each
carries the SHA-256 of its bytes, so that results can name what they were made with.
"""

from __future__ import annotations

import glob
import hashlib
import os
from dataclasses import dataclass

from ..operators.resistance import TableError, check_table

HOME = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "config")

#: Quantities in pixels, by the power of the tier's scale that they grow with.
SCALED = {
    ("points", "min_separation_px"): 1,
    ("wall_to_wall", "strip_width_px"): 1,
    ("regions", "min_patch_px"): 2,
    ("regions", "min_separation_px"): 1,
    ("regions", "max_region_px"): 2,
    ("advanced", "source", "random_field_length_scale"): 1,
    ("advanced", "ground", "edge_width_px"): 1,
    ("advanced", "ground", "patch_radius_px"): 1,
}


def read_yaml(path: str) -> tuple[dict, str]:
    """A file's mapping and the SHA-256 of its bytes."""
    import yaml

    with open(path, "rb") as f:
        data = f.read()
    found = yaml.safe_load(data)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found, hashlib.sha256(data).hexdigest()


def table_of(d: dict, name: str = "") -> dict:
    """A resistance table as the engine takes it, checked; a breach of its rules raises ``TableError``."""
    name = d.get("table_id") or name
    if not name:
        raise TableError("a table needs a table_id")
    r_max = _number(d, "r_max", name)
    base = d.get("base", "landcover")
    out: dict = {"r_max": r_max, "base": base}
    if base == "landcover":
        out["landcover"] = _by_class(d.get("landcover"), f"{name}: landcover")
    elif base == "ghm":
        given = d.get("ghm_base") or {}
        out["a"], out["b"] = _number(given, "a", name), _number(given, "b", name)
    elif base == "constant":
        out["constant"] = _number(d, "constant_base", name)
    else:
        raise TableError(f"{name}: unknown base {base}")
    if d.get("slope"):
        out["slope"] = (_number(d["slope"], "per_degree", name), float(d["slope"].get("cap_degrees", 45.0)))
    if d.get("elevation_bands"):
        out["bands"] = [(_number(b, "max_m", name), _number(b, "factor", name)) for b in d["elevation_bands"]]
    if d.get("roads"):
        out["roads"], out["buffer_m"] = _by_class(d["roads"].get("by_class"), f"{name}: roads"), float(d["roads"].get("buffer_m", 50.0))
    if d.get("ghm_additive") is not None:
        out["ghm_additive"] = float(d["ghm_additive"])
    water = d.get("water") or {}
    out["water"] = (water.get("mode", "table"), None if water.get("value") is None else float(water["value"]))
    out["nodata_classes"] = [int(c) for c in d.get("nodata_classes") or []]
    check_table(name, out)
    return out


def _number(d: dict, key: str, name: str) -> float:
    if not isinstance(d.get(key), (int, float)):
        raise TableError(f"{name}: {key} must be a number")
    return float(d[key])


def _by_class(values, what: str) -> dict[int, float]:
    if not isinstance(values, dict) or not values:
        raise TableError(f"{what} needs values by class")
    return {int(k): float(v) for k, v in values.items()}


def load_tables(folder: str | None = None) -> dict[str, dict]:
    """All tables of a folder by id, in the order of file names; an id that occurs twice raises ``TableError``.

    Each table also holds its ``provenance``: id, version, SHA-256 and r_max.
    """
    out: dict[str, dict] = {}
    for path in sorted(glob.glob(os.path.join(folder or os.path.join(HOME, "tables"), "*.yaml"))):
        d, digest = read_yaml(path)
        table = table_of(d)
        if d["table_id"] in out:
            raise TableError(f"{path}: table {d['table_id']} occurs twice")
        table["provenance"] = {"table_id": d["table_id"], "version": int(d.get("version", 1)), "sha256": digest, "r_max": table["r_max"]}
        out[d["table_id"]] = table
    return out


def write_table(table: dict, name: str, path: str) -> str:
    """Write a table, such as a perturbed one, once; returns its digest and leaves a file that is there as it is."""
    import yaml

    if not os.path.exists(path):
        d: dict = {"table_id": name, "r_max": table["r_max"], "base": table["base"], "water": {"mode": table["water"][0], "value": table["water"][1]}}
        if "landcover" in table:
            d["landcover"] = dict(table["landcover"])
        if table["base"] == "ghm":
            d["ghm_base"] = {"a": table["a"], "b": table["b"]}
        if table["base"] == "constant":
            d["constant_base"] = table["constant"]
        if "slope" in table:
            d["slope"] = dict(zip(("per_degree", "cap_degrees"), table["slope"], strict=True))
        if "bands" in table:
            d["elevation_bands"] = [{"max_m": m, "factor": f} for m, f in table["bands"]]
        if "roads" in table:
            d["roads"] = {"by_class": dict(table["roads"]), "buffer_m": table["buffer_m"]}
        if "ghm_additive" in table:
            d["ghm_additive"] = table["ghm_additive"]
        with open(path + ".part", "w", encoding="utf-8") as f:
            yaml.safe_dump(d, f, sort_keys=True)
        os.replace(path + ".part", path)
    return read_yaml(path)[1]


def load_sources(path: str | None = None) -> dict:
    """A source configuration with its ``sha256``."""
    found, digest = read_yaml(path or os.path.join(HOME, "sources.yaml"))
    if "config_id" not in found:
        raise ValueError("a source configuration needs a config_id")
    for kind in ("points", "regions"):
        low, high = found.get(kind, {}).get("k_range", (2, 2))
        if not 2 <= low <= high:
            raise ValueError(f"{kind}: k_range must be two numbers from 2 on")
    return found | {"sha256": digest}


def for_tier(config: dict, tier: str) -> dict:
    """The configuration with its pixel quantities scaled for a tier; an unknown tier has scale 1."""
    scale = int(config.get("tiers", {}).get(tier, {}).get("scale", 1))

    def grown(value, place: tuple):
        if isinstance(value, dict):
            return {k: grown(v, (*place, k)) for k, v in value.items()}
        return value * scale ** SCALED[place] if place in SCALED else value

    return grown(config, ())


def profile(name: str, folder: str) -> dict:
    """A cluster or dataset profile by name, or by path."""
    path = name if name.endswith((".yaml", ".yml")) else os.path.join(folder, f"{name}.yaml")
    if not os.path.exists(path):
        raise FileNotFoundError(f"no profile {name} in {folder}")
    found, digest = read_yaml(path)
    return found | {"sha256": digest}


def spark_settings(cluster: dict) -> dict[str, str]:
    """A cluster profile's resources as Spark settings: cores, memory and executors of a task."""
    keys = {"cpus_per_task": "spark.executor.cores", "mem_gb": "spark.executor.memory", "max_concurrent": "spark.dynamicAllocation.maxExecutors"}
    return {to: f"{cluster[key]}g" if key == "mem_gb" else str(cluster[key]) for key, to in keys.items() if key in cluster}


@dataclass(frozen=True)
class Preset:
    """How rasters are turned into graphs and solved."""

    name: str
    method: str | None = None
    four: bool = False
    mean_resistance: bool = False

    @staticmethod
    def load(path: str) -> Preset:
        d, _ = read_yaml(path)
        methods = {"direct": "direct", "cholmod": "direct", "multigrid": "multigrid", "cg+amg": "multigrid"}
        if d.get("solver") not in methods or d.get("precision", "double") != "double":
            raise ValueError(f"{path}: unknown solver or precision")
        return Preset(d["preset_id"], methods[d["solver"]], bool(d.get("connect_four_neighbors_only")), bool(d.get("connect_using_avg_resistances")))


def presets(folder: str | None = None) -> dict[str, Preset]:
    found = [Preset.load(p) for p in sorted(glob.glob(os.path.join(folder or os.path.join(HOME, "solvers"), "*.yaml")))]
    return {p.name: p for p in found}
