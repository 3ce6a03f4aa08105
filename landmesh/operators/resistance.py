"""From covariate cells to resistance surfaces, by declarative tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


class TableError(ValueError):
    """A resistance table that breaks its own rules."""


def check_table(name: str, t: dict) -> None:
    """The rules that every resistance table obeys; a breach raises ``TableError``."""
    found = broken_rules(t)
    if found:
        raise TableError(f"{name}: {'; '.join(found)}")


def broken_rules(t: dict) -> list[str]:
    out, r_max = [], t["r_max"]
    rule = lambda ok, text: None if ok else out.append(text)
    rule(r_max > 1, "r_max must be over 1")
    if t["base"] == "landcover":
        rule(all(c in t["landcover"] for c in K.LANDCOVER if c), "all land-cover classes need a value")
        rule(all(1 <= v <= r_max for v in t["landcover"].values()), "land-cover values are from 1 to r_max")
    elif t["base"] == "ghm":
        rule(t["a"] > 0 and t["b"] > 0, "the modification's factor and power must be positive")
    else:
        rule(t["base"] == "constant" and t["constant"] >= 1, "a constant base is at least 1")
    rule(set(t.get("roads", {})) <= {1, 2, 3, 4, 5} and t.get("buffer_m", 0.0) >= 0, "road classes are 1 to 5, their distance not negative")
    rule("slope" not in t or (t["slope"][0] >= 0 and t["slope"][1] > 0), "slope needs a rate and a positive cap")
    limits = [b for b, _ in t.get("bands", [])]
    rule(limits == sorted(limits) and all(f > 0 for _, f in t.get("bands", [])), "elevation bands must ascend, their factors be positive")
    rule(t.get("ghm_additive", 0.0) >= 0, "added modification is not negative")
    mode, value = t["water"]
    rule(mode in ("barrier", "nodata", "table"), "water is a barrier, no data or as in the table")
    rule(mode != "barrier" or (value is not None and value >= 1), "a barrier needs a value of at least 1")
    return out


def lookup(values: dict[int, float], key: Column, default: float) -> Column:
    """The value of a class, or the default for unknown ones."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), float(v))])
    return F.coalesce(F.try_element_at(table, key.cast("int")), F.lit(float(default)))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(float(low))), F.lit(float(high)))


def base_term(t: dict) -> Column:
    if t["base"] == "landcover":
        return lookup(t["landcover"], F.col("landcover"), t["r_max"])
    if t["base"] == "ghm":
        g = clipped(F.col("ghm"), 0, 1)
        return 1 + t["a"] * (g * g if t["b"] == 2.0 else F.pow(g, F.lit(t["b"])))
    return F.lit(float(t["constant"]))


def slope_factor(t: dict) -> Column:
    if "slope" not in t:
        return F.lit(1.0)
    per, cap = t["slope"]
    return 1 + per * clipped(F.col("slope"), 0, cap)


def band_factor(t: dict) -> Column:
    """Factor of the elevation band (lower, upper] that holds the cell; above all bands the last one's."""
    bands = t.get("bands")
    if not bands:
        return F.lit(1.0)
    e = F.coalesce(F.col("elevation").cast("double"), F.lit(0.0))
    out = F.when(e <= bands[0][0], F.lit(bands[0][1]))
    for limit, factor in bands[1:]:
        out = out.when(e <= limit, F.lit(factor))
    return out.otherwise(F.lit(bands[-1][1]))


def road_penalty(t: dict) -> Column:
    if "roads" not in t:
        return F.lit(0.0)
    on_road = (F.col("road_distance") <= t["buffer_m"]) & (F.col("road_class") > 0)
    return F.when(on_road, lookup(t["roads"], F.col("road_class"), 0.0)).otherwise(F.lit(0.0))


def modification(t: dict) -> Column:
    return t.get("ghm_additive", 0.0) * clipped(F.col("ghm"), 0, 1)


def is_nodata(t: dict) -> Column:
    classes = [K.NODATA_CLASS, *t.get("nodata_classes", []), *([K.WATER_CLASS] if t["water"][0] == "nodata" else [])]
    return F.col("landcover").isin(classes)


def resistance(t: dict) -> Column:
    """The cell's resistance within [1, r_max], 1 where there is no data, in single precision."""
    r = base_term(t) * slope_factor(t) * band_factor(t) + road_penalty(t) + modification(t)
    if t["water"][0] == "barrier":
        r = F.when(F.col("landcover") == K.WATER_CLASS, F.lit(float(t["water"][1]))).otherwise(r)
    r = F.least(F.greatest(r, F.lit(1.0)), F.lit(t["r_max"]))
    return F.when(is_nodata(t), F.lit(1.0)).otherwise(r).cast("float")


def apply_tables(cells: DataFrame, tables: dict[str, dict] = K.TABLES) -> DataFrame:
    """Every cell under every table, in one pass without a shuffle: table_id, r_max, nodata and resistance."""
    for name, t in tables.items():
        check_table(name, t)
    one = [F.struct(F.lit(n).alias("table_id"), F.lit(t["r_max"]).alias("r_max"), is_nodata(t).alias("nodata"), resistance(t).alias("resistance")) for n, t in tables.items()]
    keep = [c for c in ("sid", "r", "c") if c in cells.columns]
    return cells.select(*keep, F.inline(F.array(*one)))


def statistics(surface: DataFrame) -> DataFrame:
    """Per landscape and table: extremes, median, shares and contrast of valid cells."""
    valid = F.when(~F.col("nodata"), F.col("resistance").cast("double"))
    out = surface.groupBy("sid", "table_id").agg(
        F.min(valid).alias("r_min"), F.max(valid).alias("r_max_obs"), F.median(valid).alias("r_median"),
        F.avg(F.col("nodata").cast("double")).alias("frac_nodata"),
        F.avg(F.when(~F.col("nodata"), (F.col("resistance") >= F.col("r_max")).cast("double"))).alias("frac_at_rmax"),
    )
    return out.withColumn("log10_contrast", F.log10(F.col("r_max_obs") / F.col("r_min")))
