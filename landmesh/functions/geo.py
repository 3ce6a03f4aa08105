"""Column functions on places, map grids and split blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone; outside -80 to 84 degrees the query fails."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    code = F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone
    return F.when(lat.between(-80, 84), code).otherwise(F.raise_error(F.lit("latitude outside UTM"))).cast("bigint")


def snapped_origin(x: Column, y: Column, half: Column, pixel: Column) -> tuple[Column, Column]:
    """Left and top edge, on whole pixels."""
    return F.floor((x - half) / pixel) * pixel, F.ceil((y + half) / pixel) * pixel


def degree_code(lat: Column, lon: Column) -> Column:
    """Hemisphere code of a whole-degree cell, as in N05W087."""
    ns = F.when(lat >= 0, F.format_string("N%02d", lat)).otherwise(F.format_string("S%02d", -lat))
    ew = F.when(lon >= 0, F.format_string("E%03d", lon)).otherwise(F.format_string("W%03d", -lon))
    return F.concat(ns, ew)


def degree_cells(df: DataFrame, box: tuple[Column, Column, Column, Column], step: int) -> DataFrame:
    """A row per ``step``-degree cell that a box (lat0, lat1, lon0, lon1) meets, outside the globe none."""
    lo = lambda c: (F.floor(c / step) * step).cast("bigint")
    up = F.lit(step).cast("bigint")
    df = df.withColumn("cell_lat", F.explode(F.sequence(lo(box[0]), lo(box[1]), up)))
    df = df.withColumn("cell_lon", F.explode(F.sequence(lo(box[2]), lo(box[3]), up)))
    return df.where(F.col("cell_lat").between(-90, 89) & F.col("cell_lon").between(-180, 179))


def _cos_deg(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def tile_box(lat: Column, lon: Column, half: Column) -> dict[str, Column]:
    """A box in degrees that surely holds a square tile."""
    dlat = half / K.METRES_PER_DEGREE
    worst = F.least(F.greatest(F.abs(lat - dlat), F.abs(lat + dlat)), F.lit(K.WIDTH_LATITUDE))
    dlon = half / (F.lit(K.METRES_PER_DEGREE) * F.greatest(_cos_deg(worst), F.lit(K.LEAST_COSINE)))
    return {"lat0": lat - dlat, "lat1": lat + dlat, "lon0": lon - dlon, "lon1": lon + dlon}


class Blocks:
    """Bands of latitude cut into cells of about equal width."""

    def __init__(self, degrees: float = K.BAND_DEG):
        self.deg = degrees
        self.bands = round(180 / degrees)

    def band(self, lat: Column) -> Column:
        return F.least(F.greatest(F.floor((lat + 90) / self.deg), F.lit(0)), F.lit(self.bands - 1)).cast("bigint")

    def cells(self, band: Column) -> Column:
        """Cells of a band; halves round to even."""
        middle = (band + 0.5) * self.deg - 90
        return F.greatest(F.lit(1), F.bround(360 * _cos_deg(middle) / self.deg)).cast("bigint")

    def place(self, band: Column, lon: Column) -> Column:
        n = self.cells(band)
        wrapped = F.pmod(lon + 180, F.lit(360.0))
        return F.pmod(F.floor(wrapped / (360.0 / n)), n)

    @staticmethod
    def name(band: Column, place: Column) -> Column:
        return F.format_string("b%03d_%03d", band, place)

    def id(self, lat: Column, lon: Column) -> Column:
        return self.name(self.band(lat), self.place(self.band(lat), lon))

    def bounds(self, block: Column) -> dict[str, Column]:
        band, j = F.substring(block, 2, 3).cast("bigint"), F.substring(block, 6, 3).cast("bigint")
        w = 360.0 / self.cells(band)
        return {"lat0": band * self.deg - 90, "lat1": (band + 1) * self.deg - 90, "lon0": j * w - 180, "lon1": (j + 1) * w - 180}

    def footprint(self, df: DataFrame, key: str) -> DataFrame:
        """All blocks that each tile (lat, lon, half_m) touches: rows of ``key`` and block."""
        lat, lon, half = F.col("lat"), F.col("lon"), F.col("half_m")
        dlat = half / K.METRES_PER_DEGREE
        t = df.select(key, "lon", "half_m", F.greatest(lat - dlat, F.lit(-90.0)).alias("_a"), F.least(lat + dlat, F.lit(K.TOP_LATITUDE)).alias("_b"))
        t = t.withColumn("band", F.explode(F.sequence(self.band(F.col("_a")), self.band(F.col("_b")))))
        low, high = F.greatest("_a", F.col("band") * self.deg - 90), F.least("_b", (F.col("band") + 1) * self.deg - 90)
        worst = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(K.WIDTH_LATITUDE))
        dlon = half / (F.lit(K.METRES_PER_DEGREE) * F.greatest(_cos_deg(worst), F.lit(K.LEAST_COSINE)))
        n = self.cells(F.col("band"))
        w = 360.0 / n
        j0, j1 = F.floor((lon - dlon + 180) / w), F.floor((lon + dlon + 180) / w)
        span = F.when(j1 - j0 + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.sequence(j0, j1))
        t = t.select(key, "band", n.alias("_n"), F.explode(span).alias("_j"))
        return t.select(key, self.name(F.col("band"), F.pmod("_j", "_n")).alias("block")).distinct()


def sample_uuid(dataset: Column, family: Column, key: Column) -> Column:
    """The name-based UUID (version 5) of a sample."""
    space = F.unhex(F.lit(K.SAMPLE_NAMESPACE.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(F.concat_ws("|", dataset, family, key), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("bigint").bitwiseAND(F.lit(63))).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_of(share: Column, fractions: dict[str, float] = K.SPLIT_SHARE) -> Column:
    """Train, val or test_id by cumulative fractions."""
    return F.when(share < fractions["train"], "train").when(share < fractions["train"] + fractions["val"], "val").otherwise("test_id")
