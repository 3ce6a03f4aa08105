"""Points in polygons, and rasters resampled, by equi-joins on bands and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, edges: DataFrame, band: float = 10.0) -> DataFrame:
    """The polygon that holds each point, the first by name if several do.

    ``points`` has id, x and y; ``edges`` has poly, x0, y0, x1 and y1, one row per edge of a
    closed ring (holes too). A point is inside if a ray to the right crosses an odd number
    of edges. Edges are copied to the bands of y that they span and met by band, so no
    point is compared with edges above or below its band. Points outside are left out.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    e = edges.where(F.col("y0") != F.col("y1")).withColumn("_b", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    met = points.withColumn("_b", F.floor(F.col("y") / band)).join(e, "_b")
    spans = (F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))
    at = (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    crossed = met.where(spans & (F.col("x") < at)).groupBy("id", "poly").agg(F.count(F.lit(1)).alias("n"))
    return crossed.where("n % 2 = 1").groupBy("id").agg(F.min("poly").alias("poly"))


def resampled(cells: DataFrame, value: str, size: int, to: int, nearest: bool = False) -> DataFrame:
    """A square raster of ``size`` cells read at the centres of ``to`` cells of the same extent.

    Each target cell asks for the one cell that holds its centre, or for the four around
    it with bilinear weights (border cells stand in for those outside). Rows and columns
    are asked for alone, in two tables as long as a raster's side, so the cells themselves
    never meet a table of all rasters. Missing cells drop out of the weights.
    """
    def ways(c: str) -> Column:
        at = (F.col(c) + 0.5) * (size / to)
        if nearest:
            return F.array(F.struct(F.floor(at).alias("k"), F.lit(1.0).alias("w")))
        low = F.floor(at - 0.5)
        clip = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(size - 1))
        share = at - 0.5 - low
        return F.array(F.struct(clip(low).alias("k"), (1 - share).alias("w")), F.struct(clip(low + 1).alias("k"), share.alias("w")))

    def asked(target: str, of: str) -> DataFrame:
        each = cells.sparkSession.range(to).select(F.col("id").cast("int").alias(target)).withColumn("a", F.explode(ways(target)))
        return F.broadcast(each.select(target, F.col("a.k").cast("bigint").alias(of), F.col("a.w").alias(f"_{of}")))

    own = cells.where(F.col("sid").isNotNull() & F.col(value).isNotNull()).select("sid", "r", "c", F.col(value).alias("_v"))
    met = own.join(asked("tr", "r"), "r").join(asked("tc", "c"), "c").withColumn("w", F.col("_r") * F.col("_c"))
    return met.groupBy("sid", "tr", "tc").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))


def crossed_cells(lines: DataFrame, size: float) -> DataFrame:
    """All cells of width ``size`` that segments (line, x, y, x1, y1) touch: line, r and c.

    A segment is cut where it crosses grid lines; the middle of each part names its cell.
    """
    def cuts(a: str, b: str) -> Column:
        low, high = F.floor(F.least(a, b) / size) + 1, F.ceil(F.greatest(a, b) / size) - 1
        inner = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(inner, lambda k: (k * size - F.col(a)) / (F.col(b) - F.col(a)))

    at = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("x", "x1"), cuts("y", "y1")))
    s = lines.withColumn("at", at).select("*", F.posexplode("at").alias("k", "a")).withColumn("b", F.get("at", F.col("k") + 1)).where("b IS NOT NULL")
    mid = (F.col("a") + F.col("b")) / 2
    return s.select("line", F.floor((F.col("y") + mid * (F.col("y1") - F.col("y"))) / size).alias("r"), F.floor((F.col("x") + mid * (F.col("x1") - F.col("x"))) / size).alias("c"))


def edges_of_wkt(polygons: DataFrame) -> DataFrame:
    """Edges of polygons and multipolygons kept as WKT (poly, wkt): poly, x0, y0, x1, y1, for all rings."""
    ring = F.explode(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), 1)).alias("ring")
    points = F.transform(F.split("ring", r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda z: z.cast("double")))
    rings = polygons.select("poly", ring).select("poly", points.alias("p"))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    return rings.select("poly", F.explode(pairs).alias("e")).select("poly", F.col("e.a")[0].alias("x0"), F.col("e.a")[1].alias("y0"), F.col("e.b")[0].alias("x1"), F.col("e.b")[1].alias("y1"))
