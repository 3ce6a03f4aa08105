"""Queries on conductance graphs, currents, components, sources and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import graph as G
from ..sources import fixtures as X
from .registry import query
from .surfaces import SURFACE, surface

# Resistance of the small rasters: 1 to 10, from the cell's value.
_R = "1.0 + 9.0 * abs(v)"
SMALL = f"{X.GRIDS}, rs AS (SELECT sid, label, r, c, v, 1.0::DOUBLE + 9.0::DOUBLE * abs(v) AS res FROM grids)"
OFF = "off(dr, dc, dg) AS (VALUES (0, 1, false), (1, 0, false), (1, 1, true), (1, -1, true))"
EDGE = f"{OFF}, edge AS (SELECT a.sid, a.r, a.c, b.r AS r2, b.c AS c2, (1.0 / a.res + 1.0 / b.res) / 2 / (CASE WHEN dg THEN sqrt(2.0::DOUBLE) ELSE 1 END) AS g FROM rs a, off JOIN rs b ON a.sid = b.sid AND b.r = a.r + dr AND b.c = a.c + dc)"
WAYS = "ways AS (SELECT sid, r, c, r2, c2, g FROM edge UNION ALL SELECT sid, r2, c2, r, c, g FROM edge)"
FLOW = "flow AS (SELECT w.sid, w.r, w.c, g * (a.v - b.v) AS i FROM ways w JOIN rs a ON a.sid = w.sid AND a.r = w.r AND a.c = w.c JOIN rs b ON b.sid = w.sid AND b.r = w.r2 AND b.c = w.c2)"


def small(spark, d):
    return X.grids(spark, d).withColumn("res", 1.0 + 9.0 * F.abs("v"))


def r6(*names):
    return [F.round(c, 6).alias(c) for c in names]


def signed_round(c, digits: int = 6):
    """Rounded as SQL engines do: a negative number that comes to zero gives -0.0, which tells inside arrays."""
    out = F.round(c, digits)
    return F.when(out == 0, c * F.lit(0.0)).otherwise(out)


@query("J-07_neighbour_join", f"WITH {SMALL}, {EDGE} SELECT sid, r, c, r2, c2 FROM edge")
def neighbour_join(spark, d):
    return C.neighbours(small(spark, d), "res").select("sid", "r", "c", "r2", "c2")


@query("G-01_node_index", f"WITH {SMALL} SELECT sid, r, c, row_number() OVER (PARTITION BY sid ORDER BY r, c) - 1 AS node FROM rs")
def node_index(spark, d):
    n = F.row_number().over(Window.partitionBy("sid").orderBy("r", "c")) - 1
    return small(spark, d).select("sid", "r", "c", n.cast("bigint").alias("node"))


@query("G-02_conductance_graph", f"WITH {SMALL}, {EDGE} SELECT sid, r, c, r2, c2, round(g, 9) AS g FROM edge")
def graph(spark, d):
    return G.edges(small(spark, d), "res").select("sid", "r", "c", "r2", "c2", F.round("g", 9).alias("g"))


@query("G-02b_four_neighbour_mean", f"WITH {SMALL}, {OFF} SELECT a.sid, a.r, a.c, b.r AS r2, b.c AS c2, round(1.0 / ((a.res + b.res) / 2), 9) AS g FROM rs a, off JOIN rs b ON a.sid = b.sid AND b.r = a.r + dr AND b.c = a.c + dc WHERE NOT dg")
def graph4(spark, d):
    return G.edges(small(spark, d), "res", four=True, mean_resistance=True).select("sid", "r", "c", "r2", "c2", F.round("g", 9).alias("g"))


@query("A-14_degree", f"WITH {SMALL}, {EDGE}, {WAYS} SELECT sid, r, c, count(*) AS n, round(sum(g), 6) AS degree FROM ways GROUP BY sid, r, c")
def degree(spark, d):
    return G.degree(G.edges(small(spark, d), "res")).select("sid", "r", "c", "n", *r6("degree"))


@query("A-15_node_current", f"WITH {SMALL}, {EDGE}, {WAYS}, {FLOW} SELECT sid, r, c, round(greatest(sum(greatest(i, 0)), sum(greatest(-i, 0))), 6) AS current FROM flow GROUP BY sid, r, c")
def node_current(spark, d):
    s = small(spark, d)
    return G.node_current(G.flows(G.edges(s, "res"), s, "v")).select("sid", "r", "c", *r6("current"))


@query("A-16_residual", f"""WITH {SMALL}, {EDGE}, {WAYS}, {FLOW}, l AS (SELECT sid, r, c, sum(i) AS lv FROM flow GROUP BY ALL),
t AS (SELECT rs.sid, CASE WHEN rs.r = 7 AND rs.c >= 6 THEN -1 ELSE rs.r * 100000 + rs.c END AS g, sum(lv - b) AS d, sum(b) AS b FROM (SELECT *, CASE WHEN r = 7 AND c >= 6 THEN 0.5 ELSE 0 END AS b FROM rs) rs JOIN l ON rs.sid = l.sid AND rs.r = l.r AND rs.c = l.c WHERE NOT (rs.r = 0 AND rs.c = 0) GROUP BY ALL)
SELECT sid, round(sqrt(sum(d * d)) / sqrt(sum(b * b)), 6) AS residual FROM t GROUP BY sid""")
def residual(spark, d):
    top = (F.col("r") == 7) & (F.col("c") >= 6)
    s = small(spark, d).withColumn("b", F.when(top, 0.5).otherwise(0.0)).withColumn("ground", (F.col("r") == 0) & (F.col("c") == 0)).withColumn("region", top)
    return G.residual(G.flows(G.edges(s, "res"), s, "v"), s, "b", "ground", "region").select("sid", *r6("residual"))


@query("A-17_cumulative_current", f"WITH {SMALL} SELECT label, r, c, round(sum(abs(v)), 6) AS cum FROM rs GROUP BY label, r, c")
def cumulative(spark, d):
    return small(spark, d).groupBy("label", "r", "c").agg(F.round(F.sum(F.abs("v")), 6).alias("cum"))


_COMP = f"""{X.GRIDS}, ok AS (SELECT sid, r, c, r * 1000000 + c AS n FROM grids WHERE v > -0.02), lk AS (SELECT a.sid, a.n AS a, b.n AS b FROM ok a JOIN ok b ON a.sid = b.sid AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach AS (SELECT sid, a, b FROM lk UNION SELECT r.sid, r.a, l.b FROM reach r JOIN lk l ON r.sid = l.sid AND r.b = l.a), low AS (SELECT sid, a AS n, min(b) AS m FROM reach GROUP BY ALL),
sizes AS (SELECT sid, m, count(*) AS size, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, m) - 1 AS label FROM low GROUP BY sid, m),
comp AS (SELECT low.sid, n // 1000000 AS r, n % 1000000 AS c, CAST(label AS INTEGER) AS label, size FROM low JOIN sizes ON low.sid = sizes.sid AND low.m = sizes.m)"""


def labelled(spark, d):
    return G.component_labels(X.grids(spark, d).where("v > -0.02").select("sid", "r", "c"))


@query("G-03_components", f"WITH RECURSIVE {_COMP} SELECT sid, r, c, label, size FROM comp")
def components(spark, d):
    return labelled(spark, d)


@query("A-18_component_sizes", f"WITH RECURSIVE {_COMP} SELECT sid, label, count(*) AS n FROM comp GROUP BY sid, label")
def component_sizes(spark, d):
    return labelled(spark, d).groupBy("sid", "label").agg(F.count(F.lit(1)).alias("n"))


@query("G-04_one_component", f"WITH RECURSIVE {_COMP} SELECT sid, count(DISTINCT label) = 1 AND min(label) >= 0 AS together, count(DISTINCT label) AS touched FROM comp WHERE r IN (0, 7) GROUP BY sid")
def one_component(spark, d):
    return labelled(spark, d).where(F.col("r").isin(0, 7)).groupBy("sid").agg(((F.countDistinct("label") == 1) & (F.min("label") >= 0)).alias("together"), F.countDistinct("label").alias("touched"))


@query("G-05_single_component", f"WITH RECURSIVE {_COMP} SELECT sid, r, c FROM comp WHERE label = 0")
def single(spark, d):
    return labelled(spark, d).where("label = 0").select("sid", "r", "c")


@query("W-03_component_rank", f"WITH RECURSIVE {_COMP} SELECT DISTINCT sid, label, size FROM comp")
def ranks(spark, d):
    return labelled(spark, d).select("sid", "label", "size").distinct()


@query("A-19_patch_centroids", f"WITH RECURSIVE {_COMP} SELECT sid, label, count(*) AS n, CAST(round_even(avg(r), 0) AS BIGINT) AS row, CAST(round_even(avg(c), 0) AS BIGINT) AS col FROM comp GROUP BY sid, label HAVING count(*) >= 4")
def patches(spark, d):
    g = labelled(spark, d).groupBy("sid", "label").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("r")).cast("bigint").alias("row"), F.bround(F.avg("c")).cast("bigint").alias("col"))
    return g.where("n >= 4")


@query("F-10_min_patch", f"WITH RECURSIVE {_COMP} SELECT sid, label FROM comp GROUP BY sid, label HAVING count(*) >= 10")
def min_patch(spark, d):
    return labelled(spark, d).groupBy("sid", "label").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("sid", "label")


@query("W-07_trim_region", f"""WITH RECURSIVE {_COMP}, m AS (SELECT sid, label, round_even(avg(r), 0) AS cr, round_even(avg(c), 0) AS cc FROM comp GROUP BY ALL)
SELECT sid, label, r, c FROM comp JOIN m USING (sid, label) QUALIFY row_number() OVER (PARTITION BY sid, label ORDER BY (r - cr) * (r - cr) + (c - cc) * (c - cc), r, c) <= 8""")
def trim(spark, d):
    l = labelled(spark, d)
    m = l.groupBy("sid", "label").agg(F.bround(F.avg("r")).alias("cr"), F.bround(F.avg("c")).alias("cc"))
    t = l.join(m, ["sid", "label"])
    d2 = (F.col("r") - F.col("cr")) * (F.col("r") - F.col("cr")) + (F.col("c") - F.col("cc")) * (F.col("c") - F.col("cc"))
    return t.withColumn("k", F.row_number().over(Window.partitionBy("sid", "label").orderBy(d2, "r", "c"))).where("k <= 8").select("sid", "label", "r", "c")


@query("C-02_wall_to_wall", f"WITH RECURSIVE {_COMP} SELECT sid, CASE WHEN r < 2 THEN 1 ELSE 2 END AS strip, CAST(round_even(avg(r), 0) AS BIGINT) AS row, CAST(round_even(avg(c), 0) AS BIGINT) AS col, count(*) AS n_pixels FROM comp WHERE label = 0 AND (r < 2 OR r >= 6) GROUP BY ALL")
def strips(spark, d):
    s = labelled(spark, d).where("label = 0 AND (r < 2 OR r >= 6)").withColumn("strip", F.when(F.col("r") < 2, 1).otherwise(2))
    return s.groupBy("sid", "strip").agg(F.bround(F.avg("r")).cast("bigint").alias("row"), F.bround(F.avg("c")).cast("bigint").alias("col"), F.count(F.lit(1)).alias("n_pixels"))


@query("A-20_strip_pixels", f"WITH {SMALL} SELECT sid, CASE WHEN c < 1 THEN 1 ELSE 2 END AS strip, count(*) AS n_pixels, round(avg(r), 6) AS row FROM rs WHERE c < 1 OR c >= 7 GROUP BY ALL")
def strip_pixels(spark, d):
    s = small(spark, d).where("c < 1 OR c >= 7").withColumn("strip", F.when(F.col("c") < 1, 1).otherwise(2))
    return s.groupBy("sid", "strip").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.avg("r"), 6).alias("row"))


_SUIT = f"su AS (SELECT sid, r, c, 1.0 / res AS s FROM rs), th AS (SELECT sid, quantile_cont(s, 0.75) AS q FROM su GROUP BY sid), src AS (SELECT su.sid, r, c, CASE WHEN s >= q THEN s ELSE 0 END AS s FROM su JOIN th ON su.sid = th.sid)"


def suited(spark, d):
    s = small(spark, d).withColumn("s", 1.0 / F.col("res"))
    q = s.groupBy("sid").agg(F.percentile("s", F.lit(0.75)).alias("q"))
    return s.join(q, "sid").select("sid", "r", "c", F.when(F.col("s") >= F.col("q"), F.col("s")).otherwise(0.0).alias("s"))


@query("C-04_suitability_field", f"WITH {SMALL}, {_SUIT} SELECT sid, r, c, round(s, 6) AS s FROM src")
def suitability(spark, d):
    return suited(spark, d).select("sid", "r", "c", *r6("s"))


@query("C-05_advanced_source", f"WITH {SMALL}, {_SUIT}, a AS (SELECT sid, r, c, r = 0 AS ground, CASE WHEN r = 0 THEN 0 ELSE s END AS s FROM src) SELECT sid, r, c, ground, round(s / sum(s) OVER (PARTITION BY sid), 6) AS source FROM a")
def advanced(spark, d):
    a = suited(spark, d).withColumn("ground", F.col("r") == 0).withColumn("s", F.when(F.col("r") == 0, 0.0).otherwise(F.col("s")))
    return a.select("sid", "r", "c", "ground", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("sid")), 6).alias("source"))


@query("C-06_omniscape_source", f"WITH {SMALL}, {_SUIT} SELECT sid, r, c, round(s / max(s) OVER (PARTITION BY sid), 6) AS source FROM src")
def omniscape_source(spark, d):
    return suited(spark, d).select("sid", "r", "c", F.round(F.col("s") / F.max("s").over(Window.partitionBy("sid")), 6).alias("source"))


@query("A-21_source_normalisation", f"WITH {SMALL}, {_SUIT} SELECT sid, round(sum(s), 6) AS total, round(max(s), 6) AS top FROM src GROUP BY sid")
def normalisation(spark, d):
    return suited(spark, d).groupBy("sid").agg(F.round(F.sum("s"), 6).alias("total"), F.round(F.max("s"), 6).alias("top"))


_EDGE_RATIO = "SELECT sid, round(avg(abs(v)) FILTER (r < 2 OR r >= 6 OR c < 2 OR c >= 6) / avg(abs(v)) FILTER (r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5), 6) AS edge_ratio FROM rs GROUP BY sid"


@query("A-22_edge_ratio", f"WITH {SMALL} {_EDGE_RATIO}")
def edge_ratio(spark, d):
    edge = (F.col("r") < 2) | (F.col("r") >= 6) | (F.col("c") < 2) | (F.col("c") >= 6)
    v = F.abs("v")
    return small(spark, d).groupBy("sid").agg(F.round(F.avg(F.when(edge, v)) / F.avg(F.when(~edge, v)), 6).alias("edge_ratio"))


_PAIR = "pr AS (SELECT a.sid, a.r, a.c, a.v AS x, b.v AS y FROM grids a JOIN grids b ON b.sid = a.sid + 1 AND a.r = b.r AND a.c = b.c WHERE a.sid % 2 = 0)"


def paired(spark, d):
    g = X.grids(spark, d)
    a = g.where("sid % 2 = 0").select("sid", "r", "c", F.col("v").alias("x"))
    b = g.where("sid % 2 = 1").select((F.col("sid") - 1).alias("sid"), "r", "c", F.col("v").alias("y"))
    return a.join(b, ["sid", "r", "c"])


@query("A-27_fidelity", f"""WITH {X.GRIDS}, {_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY x, r, c) AS rx, row_number() OVER (PARTITION BY sid ORDER BY y, r, c) AS ry FROM pr)
SELECT sid, round(sqrt(sum((x - y) * (x - y))) / sqrt(sum(y * y)), 6) AS rel_l2, round(max(abs(x - y)), 6) AS max_diff, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY sid""")
def fidelity(spark, d):
    w = Window.partitionBy("sid")
    k = paired(spark, d).withColumn("rx", F.row_number().over(w.orderBy("x", "r", "c"))).withColumn("ry", F.row_number().over(w.orderBy("y", "r", "c")))
    e = F.col("x") - F.col("y")
    g = k.groupBy("sid").agg((F.sqrt(F.sum(e * e)) / F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("rel_l2"), F.max(F.abs(e)).alias("max_diff"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    return g.select("sid", *r6("rel_l2", "max_diff", "pearson", "spearman"))


@query("A-29_relative_max_difference", f"WITH {X.GRIDS}, {_PAIR} SELECT sid, round(max(abs(x - y)) / max(abs(y)), 6) AS rel FROM pr GROUP BY sid")
def relative(spark, d):
    return paired(spark, d).groupBy("sid").agg(F.round(F.max(F.abs(F.col("x") - F.col("y"))) / F.max(F.abs("y")), 6).alias("rel"))


@query("MX-01_error_metrics", f"WITH {X.GRIDS}, {_PAIR} SELECT sid, round(avg((x - y) * (x - y)), 6) AS mse, round(avg(abs(log10(abs(x) + 1e-6) - log10(abs(y) + 1e-6))), 6) AS log_mae FROM pr GROUP BY sid")
def errors(spark, d):
    e = F.col("x") - F.col("y")
    l = F.abs(F.log10(F.abs("x") + 1e-6) - F.log10(F.abs("y") + 1e-6))
    return paired(spark, d).groupBy("sid").agg(F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(l), 6).alias("log_mae"))


@query("MX-02_top_share_overlap", f"WITH {X.GRIDS}, {_PAIR}, q AS (SELECT sid, quantile_cont(x, 0.9) AS qx, quantile_cont(y, 0.9) AS qy FROM pr GROUP BY sid) SELECT sid, round(count(*) FILTER (x >= qx AND y >= qy) / count(*) FILTER (x >= qx OR y >= qy)::DOUBLE, 6) AS iou, round(2.0 * count(*) FILTER (x >= qx AND y >= qy) / (count(*) FILTER (x >= qx) + count(*) FILTER (y >= qy)), 6) AS dice FROM pr JOIN q USING (sid) GROUP BY sid")
def overlap(spark, d):
    p = paired(spark, d)
    q = p.groupBy("sid").agg(F.percentile("x", F.lit(0.9)).alias("qx"), F.percentile("y", F.lit(0.9)).alias("qy"))
    a, b = F.col("x") >= F.col("qx"), F.col("y") >= F.col("qy")
    g = p.join(q, "sid").groupBy("sid").agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"), (F.count_if(a) + F.count_if(b)).alias("s"))
    return g.select("sid", F.round(F.col("i") / F.col("u"), 6).alias("iou"), F.round(2.0 * F.col("i") / F.col("s"), 6).alias("dice"))


@query("MX-04_local_maxima", f"WITH {SMALL}, {OFF}, b AS (SELECT a.sid, a.r, a.c, max(b.v) AS m FROM rs a JOIN rs b ON a.sid = b.sid AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY ALL) SELECT rs.sid, rs.r, rs.c FROM rs JOIN b USING (sid, r, c) WHERE rs.v > b.m")
def maxima(spark, d):
    s = small(spark, d)
    n = C.neighbours(s, "v")
    n = n.select("sid", "r", "c", F.col("vb").alias("m")).unionByName(n.select("sid", F.col("r2").alias("r"), F.col("c2").alias("c"), F.col("va").alias("m")))
    return s.join(n.groupBy("sid", "r", "c").agg(F.max("m").alias("m")), ["sid", "r", "c"]).where("v > m").select("sid", "r", "c")


@query("LD-02_norm_stats", f"WITH {SMALL} SELECT round(avg(ln(res)), 6) AS mean, round(stddev_pop(ln(res)), 6) AS std, count(DISTINCT sid) AS n_train_items FROM rs WHERE label < 8")
def norm_stats(spark, d):
    return small(spark, d).where("label < 8").agg(F.round(F.avg(F.log("res")), 6).alias("mean"), F.round(F.stddev_pop(F.log("res")), 6).alias("std"), F.countDistinct("sid").alias("n_train_items"))


@query("LD-04_one_hot", f"WITH {SMALL} SELECT sid, r, c, CASE WHEN r < 1 THEN 1 ELSE 0 END AS k1, CASE WHEN r >= 7 THEN 1 ELSE 0 END AS k2 FROM rs")
def one_hot(spark, d):
    return small(spark, d).select("sid", "r", "c", (F.col("r") < 1).cast("int").alias("k1"), (F.col("r") >= 7).cast("int").alias("k2"))


@query("LD-05_upper_triangle", "WITH e AS (SELECT vec_id, i, j, CAST(embedding[i * 8 + j + 1] AS DOUBLE) AS v FROM embeddings, range(8) a(i), range(8) b(j) WHERE i < j) SELECT vec_id, list(round(v, 6) ORDER BY i, j) AS reff FROM e GROUP BY vec_id")
def triangle(spark, d):
    at = F.array(*[F.lit(i * 8 + j) for i in range(8) for j in range(i + 1, 8)])
    e = X.table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(at, lambda k: signed_round(F.get("embedding", k).cast("double"))).alias("reff"))


_BASEQ = "WITH q AS (SELECT sid, min(v) AS lo, max(v) AS hi, sum(v) AS s FROM rs GROUP BY sid)"


@query("Q-01_pairwise_flags", f"""WITH {SMALL}, q AS (SELECT sid, count(*) FILTER (res >= 2.5) / count(*)::DOUBLE AS sat, avg(v) AS resid, max(label) AS label FROM rs GROUP BY sid)
SELECT sid, concat_ws(',', CASE WHEN sid % 11 = 0 THEN 'not_converged' END, CASE WHEN sid % 13 = 0 THEN 'fallback_solver' END, CASE WHEN sid % 17 = 0 THEN 'isolated_focal' END, CASE WHEN sid % 11 <> 0 AND resid > 0.01 THEN 'residual_high' END, CASE WHEN sat > 0.1 THEN 'rmax_saturated' END) AS qc_flags FROM q""")
def pairwise_flags(spark, d):
    q = small(spark, d).groupBy("sid").agg(F.avg((F.col("res") >= 2.5).cast("double")).alias("sat"), F.avg("v").alias("resid"))
    conv = F.col("sid") % 11 != 0
    rules = [(~conv, "not_converged"), (F.col("sid") % 13 == 0, "fallback_solver"), (F.col("sid") % 17 == 0, "isolated_focal"), (conv & (F.col("resid") > 0.01), "residual_high"), (F.col("sat") > 0.1, "rmax_saturated")]
    return q.select("sid", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), ",").alias("qc_flags"))


@query("Q-02_advanced_flags", f"""WITH {SMALL}, q AS (SELECT sid, avg(v) AS resid FROM rs GROUP BY sid) SELECT sid, concat_ws(',', CASE WHEN sid % 11 = 0 THEN 'not_converged' END, CASE WHEN sid % 13 = 0 THEN 'fallback_solver' END, CASE WHEN sid % 11 <> 0 AND resid > 1e-6 THEN 'residual_high' END) AS qc_flags FROM q""")
def advanced_flags(spark, d):
    from ..operators.index import solver_flags

    q = small(spark, d).groupBy("sid").agg(F.avg("v").alias("resid"), F.max(F.abs("v")).alias("top"))
    f = solver_flags(F.col("sid") % 11 != 0, F.col("sid") % 13 == 0, F.lit(True), F.col("top") == 0, F.col("resid"))
    return q.select("sid", F.array_join(f, ",").alias("qc_flags"))


@query("Q-03_edge_artifact", f"WITH {SMALL}, e AS ({_EDGE_RATIO}) SELECT sid, edge_ratio > 1.05 AS edge_artifact FROM e")
def edge_artifact(spark, d):
    return edge_ratio(spark, d).select("sid", (F.col("edge_ratio") > 1.05).alias("edge_artifact"))


@query("Q-04_conservation", f"WITH {SMALL} SELECT sid, round(greatest(abs(max(v) FILTER (r = 0) - 1), abs(max(v) FILTER (r = 7) - 1)), 6) AS conservation_err FROM rs GROUP BY sid")
def conservation(spark, d):
    top = lambda k: F.abs(F.max(F.when(F.col("r") == k, F.col("v"))) - 1)
    return small(spark, d).groupBy("sid").agg(F.round(F.greatest(top(0), top(7)), 6).alias("conservation_err"))


@query("V-03_surface_checks", f"WITH {X.CELLS}, {SURFACE} SELECT sid, table_id, count(*) FILTER (NOT nodata AND NOT (resistance >= 1 AND resistance <= r_max)) AS bad_valid, count(*) FILTER (nodata AND resistance <> 1) AS bad_nodata, count(*) = 1024 AS complete FROM surface GROUP BY ALL")
def surface_checks(spark, d):
    x = F.col("resistance")
    return surface(spark, d).groupBy("sid", "table_id").agg(F.count_if(~F.col("nodata") & ~((x >= 1) & (x <= F.col("r_max")))).alias("bad_valid"), F.count_if(F.col("nodata") & (x != 1)).alias("bad_nodata"), (F.count(F.lit(1)) == 1024).alias("complete"))


@query("V-04_shape_checks", f"WITH {X.GRIDS} SELECT sid, count(*) = 64 AND max(r) = 7 AND max(c) = 7 AS shape_ok, count(*) FILTER (isnan(v) OR isinf(v)) = 0 AS finite FROM grids GROUP BY sid")
def shape_checks(spark, d):
    return X.grids(spark, d).groupBy("sid").agg(((F.count(F.lit(1)) == 64) & (F.max("r") == 7) & (F.max("c") == 7)).alias("shape_ok"), (F.count_if(F.isnan("v") | (F.abs("v") == float("inf"))) == 0).alias("finite"))


@query("V-06_error_report", f"WITH {X.GRIDS}, e AS (SELECT sid, unnest(list_filter([CASE WHEN max(v) > 0.4 THEN 'too_high' END, CASE WHEN min(v) < -0.4 THEN 'too_low' END], lambda x: x IS NOT NULL)) AS code FROM grids GROUP BY sid) SELECT sid, code FROM e")
def report(spark, d):
    g = X.grids(spark, d).groupBy("sid").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    codes = F.array_compact(F.array(F.when(F.col("hi") > 0.4, F.lit("too_high")), F.when(F.col("lo") < -0.4, F.lit("too_low"))))
    return g.select("sid", F.explode(codes).alias("code"))
