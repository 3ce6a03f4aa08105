"""Queries on the index: joins, sets, order, quality, routing, analytics, cost."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo as G
from ..operators import index as I
from ..operators import splits as L
from ..sources import fixtures as X
from .registry import query

TASK = "CASE kind WHEN 'points' THEN 'T1,T2' WHEN 'wall_to_wall' THEN 'T1W' WHEN 'advanced' THEN 'T3' ELSE 'T4' END"
GROUP = "CASE config WHEN 'points' THEN 'T1' WHEN 'advanced' THEN 'T3' WHEN 'omniscape' THEN 'T4' ELSE 'T1W' END"
ALL = f"{X.INDEX}, ix AS (SELECT *, {TASK} AS task, {GROUP} AS task_group, CASE WHEN qc_flags = 'fallback_solver' THEN 'iterative' ELSE 'direct' END AS solver, qc_flags IN ('', 'fallback_solver', 'rmax_saturated') AS qc_pass, qc_flags IN ('', 'fallback_solver') AS qc_train FROM idx)"


def full(spark, d):
    i = X.index(spark, d)
    ok, train = I.quality_pass(I.flag_list(F.col("qc_flags")))
    return i.withColumns({"task": I.mapped(K.TASK_OF_KIND, F.col("kind")), "task_group": I.mapped(K.GROUP_OF, F.col("config")), "solver": F.when(F.col("qc_flags") == "fallback_solver", "iterative").otherwise("direct"), "qc_pass": ok, "qc_train": train})


def r(*names, n=9):
    return [F.round(c, n).alias(c) for c in names]


@query("SRC-01_index_scan", f"WITH {ALL} SELECT sample_id, config, kind, tier, family FROM ix")
def scan(spark, d):
    return full(spark, d).select("sample_id", "config", "kind", "tier", "family")


@query("A-03_timing_summary", f"WITH {ALL} SELECT tier, task, solver, count(solve_time_s) AS n, round(median(solve_time_s), 9) AS t_median, round(quantile_cont(solve_time_s, 0.9), 9) AS t_p90, round(max(solve_time_s), 9) AS t_max, round(avg(solve_time_s), 9) AS t_mean, max(maxrss_mb) AS rss_max_mb FROM ix GROUP BY ALL")
def timing(spark, d):
    return I.timing(full(spark, d)).select("tier", "task", "solver", "n", *r("t_median", "t_p90", "t_max", "t_mean"), "rss_max_mb")


@query("A-04_two_level_totals", f"WITH {ALL}, s AS (SELECT tier, family, sample_id, sum(solve_time_s) AS t FROM ix GROUP BY ALL) SELECT tier, family, count(*) AS n, round(median(t), 5) AS median, round(avg(t), 5) AS mean, round(max(t), 5) AS max FROM s GROUP BY ALL")
def two_level(spark, d):
    s = full(spark, d).groupBy("tier", "family", "sample_id").agg(F.sum("solve_time_s").alias("t"))
    return s.groupBy("tier", "family").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("t"), 5).alias("median"), F.round(F.avg("t"), 5).alias("mean"), F.round(F.max("t"), 5).alias("max"))


@query("A-05_flag_counts", f"WITH {ALL} SELECT tier, kind, qc_flags, count(*) AS n FROM ix WHERE qc_flags <> '' GROUP BY ALL")
def flag_counts(spark, d):
    return full(spark, d).where("qc_flags <> ''").groupBy("tier", "kind", "qc_flags").agg(F.count(F.lit(1)).alias("n"))


@query("A-05b_pass_rates", f"WITH {ALL} SELECT round(avg(CAST(qc_pass AS DOUBLE)), 6) AS pass_rate, round(avg(CAST(qc_train AS DOUBLE)), 6) AS train_rate FROM ix")
def pass_rates(spark, d):
    return full(spark, d).agg(F.round(F.avg(F.col("qc_pass").cast("double")), 6).alias("pass_rate"), F.round(F.avg(F.col("qc_train").cast("double")), 6).alias("train_rate"))


@query("A-06_storage", f"WITH {ALL} SELECT kind, sum(maxrss_mb)::BIGINT AS total, round(sum(maxrss_mb) / count(DISTINCT sample_id)::DOUBLE, 6) AS per_sample FROM ix GROUP BY kind")
def storage(spark, d):
    g = full(spark, d).groupBy("kind").agg(F.sum("maxrss_mb").alias("total"), F.countDistinct("sample_id").alias("k"))
    return g.select("kind", "total", F.round(F.col("total") / F.col("k"), 6).alias("per_sample"))


_KINDS = ["points", "wall_to_wall", "advanced", "omniscape"]


@query("A-07_median_pivot", f"WITH {ALL} SELECT tier, {', '.join(f'''round(median(solve_time_s) FILTER (kind = '{k}'), 9) AS {k}''' for k in _KINDS)} FROM ix GROUP BY tier")
def median_pivot(spark, d):
    p = full(spark, d).groupBy("tier").pivot("kind", _KINDS).agg(F.median("solve_time_s"))
    return p.select("tier", *r(*_KINDS))


@query("A-08_pivot_with_total", f"WITH {ALL} SELECT family, config, {', '.join(f'''count(*) FILTER (tier = '{t}') AS {t.lower()}''' for t in K.TIER_SIZE)}, count(*) AS total FROM ix GROUP BY ALL")
def pivot_total(spark, d):
    p = full(spark, d).groupBy("family", "config").pivot("tier", list(K.TIER_SIZE)).count().na.fill(0)
    total = sum((F.col(t) for t in K.TIER_SIZE), F.lit(0))
    return p.select("family", "config", *[F.col(t).alias(t.lower()) for t in K.TIER_SIZE], total.cast("bigint").alias("total"))


@query("A-09_total_row", f"WITH {ALL} SELECT coalesce(tier, 'total') AS tier, count(*) AS n, round(sum(solve_time_s), 4) AS seconds FROM ix GROUP BY ROLLUP (tier)")
def total_row(spark, d):
    return full(spark, d).rollup("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("solve_time_s"), 4).alias("seconds")).select(F.coalesce("tier", F.lit("total")).alias("tier"), "n", "seconds")


_PIX = X.case("tier", {t: float(s * s) for t, s in K.TIER_SIZE.items()})


@query("A-10_power_law", f"WITH {ALL}, p AS (SELECT kind, ln({_PIX}) AS x, ln(solve_time_s) AS y FROM ix) SELECT kind, round(exp(regr_intercept(y, x)), 5) AS a, round(regr_slope(y, x), 6) AS b FROM p GROUP BY kind")
def power_law(spark, d):
    i = full(spark, d).withColumn("pixels", I.mapped({t: float(s * s) for t, s in K.TIER_SIZE.items()}, F.col("tier")))
    return I.power_law(i, "pixels", "solve_time_s", "kind").select("kind", F.round("a", 5).alias("a"), F.round("b", 6).alias("b"))


@query("A-11_describe", f"WITH {ALL} SELECT resistance_table_id, count(*) AS n, round(avg(solve_time_s), 9) AS mean, round(stddev_samp(solve_time_s), 9) AS std, round(min(solve_time_s), 9) AS min, round(quantile_cont(solve_time_s, 0.25), 9) AS q25, round(quantile_cont(solve_time_s, 0.75), 9) AS q75, round(max(solve_time_s), 9) AS max FROM ix GROUP BY ALL")
def describe(spark, d):
    t = "solve_time_s"
    g = full(spark, d).groupBy("resistance_table_id").agg(F.count(t).alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"), F.percentile(t, F.lit(0.25)).alias("q25"), F.percentile(t, F.lit(0.75)).alias("q75"), F.max(t).alias("max"))
    return g.select("resistance_table_id", "n", *r("mean", "std", "min", "q25", "q75", "max"))


@query("A-25_value_counts", f"WITH {ALL} SELECT config, count(*) AS n, bool_and(qc_pass) AS all_pass FROM ix GROUP BY config")
def value_counts(spark, d):
    return full(spark, d).groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.bool_and("qc_pass").alias("all_pass"))


@query("A-28_verdict_table", f"WITH {ALL}, m AS (SELECT tier, avg(solve_time_s) AS mean, max(solve_time_s) AS max, min(solve_time_s) AS min FROM ix WHERE kind = 'omniscape' GROUP BY tier) SELECT tier, round(mean, 9) AS mean, round(max, 9) AS max, round(min, 9) AS min, round(mean / min, 9) AS ratio FROM m")
def verdict(spark, d):
    m = full(spark, d).where("kind = 'omniscape'").groupBy("tier").agg(F.avg("solve_time_s").alias("mean"), F.max("solve_time_s").alias("max"), F.min("solve_time_s").alias("min"))
    return m.withColumn("ratio", F.col("mean") / F.col("min")).select("tier", *r("mean", "max", "min", "ratio"))


@query("P-24_ood_flags", f"""WITH {ALL}, s AS (SELECT *, CASE CAST(sample_id % 5 AS INTEGER) WHEN 0 THEN 'ood_region' WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test_id' END AS split FROM ix)
SELECT sample_id, config, split = 'ood_region' AS test_ood_region, tier IN ('XL', 'XXL') AND split NOT IN ('train', 'val') AS test_ood_scale, family = 'real' AND resistance_table_id = 'forest_bird' AS test_ood_table, family = 'synthetic' AND contrast >= 1000000 AS test_ood_contrast, family = 'real' AND split = 'test_id' AS test_ood_synth2real FROM s""")
def ood(spark, d):
    s = full(spark, d).withColumn("split", F.expr("CASE CAST(sample_id % 5 AS INTEGER) WHEN 0 THEN 'ood_region' WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test_id' END"))
    return s.select("sample_id", "config", *[c.alias(k) for k, c in L.ood_flags().items()])


_SYN = f"CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test_id' END"
_FINAL = f"""h AS (SELECT *, CAST('0x' || substr(sha256('{K.SPLIT_SEED}|synthetic|' || seed), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST('0x' || substr(sha256('{K.SPLIT_SEED}|xl|' || sample_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS x FROM ix),
s0 AS (SELECT *, {_SYN} AS s FROM h),
s1 AS (SELECT *, CASE WHEN s IN ('train', 'val') AND ((family = 'real' AND resistance_table_id = 'forest_bird') OR (family = 'synthetic' AND contrast >= 1000000)) THEN 'test_ood' ELSE s END AS t FROM s0),
fin AS (SELECT *, CASE WHEN t IN ('train', 'val') AND (tier = 'XXL' OR (tier = 'XL' AND x >= 0.25)) THEN 'test_id' ELSE t END AS split FROM s1)"""


def finals(spark, d):
    i = full(spark, d).withColumn("split", G.split_of(G.hash_share(F.lit(str(K.SPLIT_SEED)), F.lit("synthetic"), F.col("seed").cast("string")))).withColumn("block_id", F.lit(None).cast("string"))
    return L.final_split(i)


@query("P-25_hold_out_demotion", f"WITH {ALL}, {_FINAL} SELECT sample_id, config, t AS split FROM s1")
def demotion(spark, d):
    i = full(spark, d).withColumn("split", G.split_of(G.hash_share(F.lit(str(K.SPLIT_SEED)), F.lit("synthetic"), F.col("seed").cast("string"))))
    f = L.ood_flags()
    return i.select("sample_id", "config", L.held_out(F.col("split"), f["test_ood_table"], f["test_ood_contrast"]).alias("split"))


@query("L-03_final_splits", f"WITH {ALL}, {_FINAL} SELECT sample_id, config, split, tier IN ('XL', 'XXL') AND split NOT IN ('train', 'val') AS test_ood_scale, family = 'real' AND split = 'test_id' AS test_ood_synth2real, qc_train AND split IN ('train', 'val') AS qc_trainval FROM fin")
def final(spark, d):
    return finals(spark, d).select("sample_id", "config", "split", "test_ood_scale", "test_ood_synth2real", (F.col("qc_train") & F.col("split").isin("train", "val")).alias("qc_trainval"))


@query("SNK-10_split_lists", f"WITH {ALL}, {_FINAL} SELECT split, count(DISTINCT sample_id) AS samples FROM fin GROUP BY split")
def split_lists(spark, d):
    return finals(spark, d).groupBy("split").agg(F.countDistinct("sample_id").alias("samples"))


@query("F-08_split_filter", f"WITH {ALL}, {_FINAL} SELECT DISTINCT sample_id FROM fin WHERE split IN ('train', 'val')")
def split_filter(spark, d):
    return finals(spark, d).where(F.col("split").isin("train", "val")).select("sample_id").distinct()


@query("P-33_quality_pass", f"WITH {ALL} SELECT sample_id, config, qc_pass, qc_train FROM ix")
def quality_pass(spark, d):
    return full(spark, d).select("sample_id", "config", "qc_pass", "qc_train")


@query("F-07_flagged", f"WITH {ALL} SELECT sample_id, config, qc_flags FROM ix WHERE qc_flags <> ''")
def flagged(spark, d):
    i = full(spark, d)
    return i.where(F.size(I.flag_list(F.col("qc_flags"))) > 0).select("sample_id", "config", "qc_flags")


@query("F-06_completed_only", f"WITH {ALL}, done AS (SELECT DISTINCT sample_id FROM ix WHERE config = 'omniscape' AND qc_pass) SELECT sample_id, config FROM ix SEMI JOIN done USING (sample_id) WHERE config IN ('points', 'advanced')")
def completed(spark, d):
    i = full(spark, d)
    done = i.where("config = 'omniscape' AND qc_pass").select("sample_id")
    return i.where(F.col("config").isin("points", "advanced")).join(done, "sample_id", "left_semi").select("sample_id", "config")


@query("J-01_inner_equi", f"WITH {ALL}, {X.TILES} SELECT i.sample_id, i.config, t.tile_id, t.realm FROM ix i JOIN tiles t ON t.c_custkey = i.sample_id WHERE i.resistance_table_id = 'amphibian'")
def inner(spark, d):
    t = X.tiles(spark, d).select("tile_id", "realm", "c_custkey")
    i = full(spark, d).where("resistance_table_id = 'amphibian'")
    return i.join(t, i.sample_id == t.c_custkey).select("sample_id", "config", "tile_id", "realm")


_IO = "ins AS (SELECT sample_id, config, family FROM ix), outs AS (SELECT sample_id, config, solve_time_s, qc_pass AS complete FROM ix WHERE sample_id % 3 > 0)"


@query("J-02_inputs_outputs", f"WITH {ALL}, {_IO} SELECT sample_id, config, family, solve_time_s FROM ins JOIN outs USING (sample_id, config) WHERE complete")
def inputs_outputs(spark, d):
    i = full(spark, d)
    outs = i.where("sample_id % 3 > 0 AND qc_pass").select("sample_id", "config", "solve_time_s")
    return i.select("sample_id", "config", "family").join(outs, ["sample_id", "config"])


@query("J-04_left_semi", f"WITH {ALL}, g AS (SELECT DISTINCT sample_id, resistance_table_id FROM ix WHERE config = 'advanced' AND qc_pass) SELECT sample_id, config FROM ix SEMI JOIN g USING (sample_id, resistance_table_id)")
def semi(spark, d):
    i = full(spark, d)
    g = i.where("config = 'advanced' AND qc_pass").select("sample_id", "resistance_table_id")
    return i.join(g, ["sample_id", "resistance_table_id"], "left_semi").select("sample_id", "config")


@query("J-15_map_lookups", f"WITH {ALL} SELECT sample_id, config, task, task_group FROM ix")
def lookups(spark, d):
    return full(spark, d).select("sample_id", "config", "task", "task_group")


@query("P-32_path", f"WITH {ALL} SELECT sample_id, config, 'data/' || tier || '/' || task_group || '/' || printf('shard-%05d.h5', sample_id // 50) AS path FROM ix")
def path(spark, d):
    return full(spark, d).select("sample_id", "config", F.concat_ws("/", F.lit("data"), "tier", "task_group", F.format_string("shard-%05d.h5", F.floor(F.col("sample_id") / 50))).alias("path"))


@query("SNK-06_index_rows", f"WITH {ALL} SELECT i.sample_id, i.config, kind, task, CAST(solve_time_s AS FLOAT)::DOUBLE AS solve_time_s, qc_pass FROM ix i WHERE sample_id % 3 > 0")
def index_rows(spark, d):
    i = full(spark, d)
    outs = i.where("sample_id % 3 > 0").select("sample_id", "config", F.col("solve_time_s").cast("float").cast("double").alias("solve_time_s"), "qc_pass")
    return i.select("sample_id", "config", "kind", "task").join(outs, ["sample_id", "config"])


@query("SNK-07_routing", f"WITH {ALL} SELECT tier, task_group, sample_id // 50 AS shard, count(*) AS configs, count(DISTINCT sample_id) AS samples FROM ix GROUP BY ALL")
def routing(spark, d):
    i = full(spark, d).withColumn("shard", F.floor(F.col("sample_id") / 50))
    return i.groupBy("tier", "task_group", "shard").agg(F.count(F.lit(1)).alias("configs"), F.countDistinct("sample_id").alias("samples"))


@query("SNK-08_export_flags", f"WITH {ALL}, {_FINAL}, u AS (SELECT sample_id FROM (SELECT DISTINCT sample_id FROM ix) WHERE sha256('mini|' || sample_id) < '4') SELECT sample_id, config, task_group, split, sample_id IN (SELECT sample_id FROM u) AS subset_mini FROM fin")
def export(spark, d):
    i = finals(spark, d)
    mini = i.select("sample_id").distinct().where(F.sha2(F.concat_ws("|", F.lit("mini"), "sample_id"), 256) < "4").withColumn("_m", F.lit(True))
    return i.join(mini, "sample_id", "left").select("sample_id", "config", "task_group", "split", F.coalesce("_m", F.lit(False)).alias("subset_mini"))


@query("SNK-11_solve_times", f"WITH {ALL} SELECT sample_id, config, tier, solve_time_s, maxrss_mb FROM ix WHERE tier IN ('S', 'M') UNION ALL SELECT sample_id, config, tier, solve_time_s, maxrss_mb FROM ix WHERE tier NOT IN ('S', 'M')")
def solve_times(spark, d):
    i = full(spark, d)
    parts = [i.where(F.col("tier").isin("S", "M")), i.where(~F.col("tier").isin("S", "M"))]
    return parts[0].unionByName(parts[1]).select("sample_id", "config", "tier", "solve_time_s", "maxrss_mb")


@query("W-05_shards", f"WITH {ALL} SELECT sample_id, (row_number() OVER (PARTITION BY tier ORDER BY sample_id) - 1) // 50 AS shard FROM (SELECT DISTINCT sample_id, tier FROM ix)")
def shards(spark, d):
    s = full(spark, d).select("sample_id", "tier").distinct()
    n = F.row_number().over(Window.partitionBy("tier").orderBy("sample_id"))
    return s.select("sample_id", F.floor((n - 1) / 50).alias("shard"))


@query("W-06_drop_duplicates", f"WITH {ALL} SELECT sample_id, config, tier FROM ix QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY config) = 1")
def drop_duplicates(spark, d):
    i = full(spark, d).groupBy("sample_id").agg(F.min_by(F.struct("config", "tier"), "config").alias("x"))
    return i.select("sample_id", "x.config", "x.tier")


@query("T-01_sorted", f"WITH {ALL} SELECT DISTINCT sample_id, tier FROM ix ORDER BY sample_id")
def sorted_ids(spark, d):
    return full(spark, d).select("sample_id", "tier").distinct().orderBy("sample_id")


@query("T-02_first_n", f"WITH {ALL} SELECT sample_id, config FROM ix ORDER BY sample_id, config LIMIT 25")
def first_n(spark, d):
    return full(spark, d).select("sample_id", "config").orderBy("sample_id", "config").limit(25)


@query("T-03_tier_order", f"WITH {ALL} SELECT tier, count(*) AS n, {X.case('tier', {t: i for i, t in enumerate(K.TIER_SIZE)})} AS place FROM ix GROUP BY tier ORDER BY place")
def tier_order(spark, d):
    g = full(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", I.mapped({t: i for i, t in enumerate(K.TIER_SIZE)}, F.col("tier"))).orderBy("place")


@query("T-04_shuffle", f"WITH {ALL} SELECT sample_id, row_number() OVER (PARTITION BY tier ORDER BY sha256('3|' || sample_id), sample_id) AS place FROM (SELECT DISTINCT sample_id, tier FROM ix)")
def shuffle(spark, d):
    s = full(spark, d).select("sample_id", "tier").distinct()
    w = Window.partitionBy("tier").orderBy(F.sha2(F.concat_ws("|", F.lit("3"), "sample_id"), 256), "sample_id")
    return s.select("sample_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("S-01_union_all", f"WITH {ALL} SELECT sample_id, 'a' AS build FROM ix WHERE tier = 'S' UNION ALL SELECT sample_id, 'b' FROM ix WHERE tier IN ('S', 'M')")
def union(spark, d):
    i = full(spark, d)
    return i.where("tier = 'S'").select("sample_id", F.lit("a").alias("build")).unionByName(i.where("tier IN ('S', 'M')").select("sample_id", F.lit("b").alias("build")))


@query("S-02_distinct", f"WITH {ALL} SELECT DISTINCT tier, family, resistance_table_id FROM ix")
def distinct(spark, d):
    return full(spark, d).select("tier", "family", "resistance_table_id").distinct()


@query("S-03_difference", f"WITH {ALL} SELECT sample_id FROM ix WHERE config = 'points' EXCEPT ALL SELECT sample_id FROM ix WHERE config = 'advanced' AND qc_pass")
def difference(spark, d):
    i = full(spark, d)
    return i.where("config = 'points'").select("sample_id").exceptAll(i.where("config = 'advanced' AND qc_pass").select("sample_id"))


@query("S-04_intersect", f"WITH {ALL}, {_FINAL} SELECT sample_id FROM fin WHERE split IN ('train', 'val') INTERSECT SELECT sample_id FROM fin WHERE split LIKE 'test%'")
def intersect(spark, d):
    f = finals(spark, d)
    return f.where(F.col("split").isin("train", "val")).select("sample_id").intersect(f.where("split LIKE 'test%'").select("sample_id"))


@query("S-05_mask_algebra", f"WITH {X.CELLS} SELECT sid, count(*) FILTER (landcover = 0 OR landcover = 80) AS united, count(*) FILTER (landcover IN (0, 10) AND road_class > 3) AS common FROM cells GROUP BY sid")
def masks(spark, d):
    a, b = F.col("landcover") == 0, F.col("landcover") == 80
    c, e = F.col("landcover").isin(0, 10), F.col("road_class") > 3
    return X.cells(spark, d).groupBy("sid").agg(F.count_if(a | b).alias("united"), F.count_if(c & e).alias("common"))


@query("P-34_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def from_json(spark, d):
    return X.runs(spark, d).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("P-36_sha256", f"WITH {ALL} SELECT sample_id, config, sha256(CAST(sample_id AS VARCHAR) || '|' || config) AS h FROM ix")
def sha(spark, d):
    return full(spark, d).select("sample_id", "config", F.sha2(F.concat_ws("|", F.col("sample_id").cast("string"), "config"), 256).alias("h"))


@query("P-35_nodata_cleanup", "SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE round(value, 3) END AS DOUBLE) AS v FROM events")
def cleanup(spark, d):
    raw = X.runs(spark, d).select("event_id", F.when(F.col("event_id") % 7 == 0, -9999.0).otherwise(F.col("seconds")).alias("v"))
    return raw.select("event_id", F.when(F.col("v") == -9999.0, 0.0).otherwise(F.round("v", 3)).alias("v"))


@query("M-07_run_states", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, round(arg_max(value, (ts, event_id)), 6) AS seconds, count(*) AS tries FROM events GROUP BY user_id) SELECT * FROM l")
def run_states(spark, d):
    at = F.struct("started", "event_id")
    return X.runs(spark, d).groupBy("user_id").agg(F.max_by("state", at).alias("state"), F.round(F.max_by("seconds", at), 6).alias("seconds"), F.count(F.lit(1)).alias("tries"))


@query("SNK-05_resume", "WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_id % 97 = 0) SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM done)")
def resume(spark, d):
    e = X.runs(spark, d)
    return e.select("user_id").distinct().join(e.where("event_id % 97 = 0").select("user_id"), "user_id", "left_anti")


_SECS = {(c, t): s for c, kind in ((c, K.KIND_OF[c]) for c in K.CONFIGS) for t, s in {t: K.COST_SECONDS[kind].get(t, K.COST_SECONDS[kind]["S"] * K.TIER_SIZE[t] ** 2 / K.TIER_SIZE["S"] ** 2) for t in K.TIER_SIZE}.items()}


@query("P-38_solve_seconds", f"WITH {ALL}, v(config, tier, s) AS (VALUES {', '.join(f'''('{c}', '{t}', {s!r}::DOUBLE)''' for (c, t), s in _SECS.items())}) SELECT sample_id, config, round(s, 6) AS seconds FROM ix JOIN v USING (config, tier)")
def seconds(spark, d):
    return full(spark, d).select("sample_id", "config", F.round(I.solve_seconds(F.col("config"), F.col("tier")), 6).alias("seconds"))


@query("P-39_wall_clock", f"WITH {ALL}, t AS (SELECT sum(solve_time_s) / 3600 AS h FROM ix) SELECT c::BIGINT AS cores, round(h / c / 24, 9) AS wall_days FROM t, (SELECT unnest([100, 500, 1000]) AS c)")
def wall_clock(spark, d):
    h = full(spark, d).agg((F.sum("solve_time_s") / 3600).alias("h"))
    return h.select("h", F.explode(F.array(*[F.lit(c) for c in (100, 500, 1000)])).alias("c")).select(F.col("c").cast("bigint").alias("cores"), F.round(F.col("h") / F.col("c") / 24, 9).alias("wall_days"))


_STRATA = [(k, v) for k, v in K.GENERATOR_MIX.items() if k != "hard"] + [(f"hard:{k}", K.GENERATOR_MIX["hard"] * v) for k, v in K.HARD_MIX.items()]
_LAND = f"""lad(tier, n) AS (VALUES {', '.join(f"('{t}', {n})" for t, n in K.LADDER.items())}), mixs(stratum, f) AS (VALUES {', '.join(f"('{s}', {f!r}::DOUBLE)" for s, f in _STRATA)}),
land AS (SELECT tier, 'synthetic' AS family, stratum, '-' AS "table", CAST(round_even(round(round_even(n * 0.6::DOUBLE, 0) * f, 6), 0) AS BIGINT) AS landscapes FROM lad, mixs
  UNION ALL SELECT tier, 'real', 'tile x table', t, CAST(ceil((n - round_even(n * 0.6::DOUBLE, 0)) / 5) AS BIGINT) FROM lad, (SELECT unnest({K.TABLE_NAMES}) AS t))"""
_SOLV = f"""per(config, p) AS (VALUES {', '.join(f"('{c}', {p}::DOUBLE)" for c, p in K.PER_LANDSCAPE.items())}),
solv AS (SELECT tier, family, config, CAST(round_even(round(n * p, 6), 0) AS BIGINT) AS solves FROM (SELECT tier, family, sum(landscapes) AS n FROM land GROUP BY ALL), per WHERE NOT (config = 'regions' AND family = 'synthetic'))"""


@query("A-23a_landscape_counts", f"WITH {_LAND} SELECT * FROM land")
def land(spark, d):
    return I.landscapes(spark)


@query("A-23b_solve_counts", f"WITH {_LAND}, {_SOLV} SELECT * FROM solv")
def solves(spark, d):
    return I.solves(I.landscapes(spark))


_ALLSEC = {(c, t): K.COST_SECONDS[K.KIND_OF[c]].get(t, K.COST_SECONDS[K.KIND_OF[c]]["S"] * K.TIER_SIZE[t] ** 2 / K.TIER_SIZE["S"] ** 2) for c in K.PER_LANDSCAPE for t in K.TIER_SIZE}


@query("A-23c_cost_table", f"""WITH {_LAND}, {_SOLV}, v(config, tier, s) AS (VALUES {', '.join(f"('{c}', '{t}', {s!r}::DOUBLE)" for (c, t), s in _ALLSEC.items())}),
m(family, tier, mb) AS (VALUES {', '.join(f"('{f}', '{t}', {v}::DOUBLE)" for f, by in K.STORAGE_MB.items() for t, v in by.items())}),
a AS (SELECT tier, sum(s * solves) AS sec FROM solv JOIN v USING (config, tier) GROUP BY tier), b AS (SELECT tier, CAST(sum(landscapes) AS BIGINT) AS landscapes, sum(landscapes * mb) / 1000 AS gb FROM land JOIN m USING (family, tier) GROUP BY tier),
c AS (SELECT tier, landscapes, round(sec * 1.15::DOUBLE / 3600, 0) AS cpu_hours, round(gb, 1) AS storage_gb FROM a JOIN b USING (tier))
SELECT coalesce(tier, 'total') AS tier, CAST(sum(landscapes) AS BIGINT) AS landscapes, sum(cpu_hours) AS cpu_hours, round(sum(storage_gb), 1) AS storage_gb FROM c GROUP BY ROLLUP (tier)""")
def cost(spark, d):
    return I.cost(I.landscapes(spark))


@query("M-01_plan_synthetic", f"WITH {X.SEEDS} SELECT seed - 20260905 AS i, seed, (seed - 20260905) // 50 AS shard FROM seeds")
def plan(spark, d):
    """Consecutive seeds, fifty landscapes a shard."""
    return X.seeds(spark, d).select((F.col("seed") - 20260905).alias("i"), "seed", F.floor((F.col("seed") - 20260905) / 50).alias("shard"))


@query("M-03_provisional_split", f"WITH {ALL}, {_FINAL} SELECT sample_id, config, split, split NOT IN ('train', 'val') AS cg_baseline FROM fin")
def provisional(spark, d):
    return finals(spark, d).select("sample_id", "config", "split", (~F.col("split").isin("train", "val")).alias("cg_baseline"))


@query("M-11_extrapolated_cost", f"WITH {ALL}, p AS (SELECT kind, ln({_PIX}) AS x, ln(solve_time_s) AS y FROM ix), f AS (SELECT kind, exp(regr_intercept(y, x)) AS a, regr_slope(y, x) AS b FROM p GROUP BY kind), t(tier, pixels, n) AS (VALUES {', '.join(f"('{t}', {s * s}.0::DOUBLE, {K.LADDER[t]})" for t, s in K.TIER_SIZE.items())}) SELECT tier, round(sum(a * pow(pixels, b) * n) / 3600, 2) AS hours FROM f, t GROUP BY tier")
def extrapolated(spark, d):
    i = full(spark, d).withColumn("pixels", I.mapped({t: float(s * s) for t, s in K.TIER_SIZE.items()}, F.col("tier")))
    fit = I.power_law(i, "pixels", "solve_time_s", "kind")
    one = F.array(*[F.struct(F.lit(t).alias("tier"), (F.col("a") * F.pow(F.lit(float(s * s)), F.col("b")) * K.LADDER[t]).alias("s")) for t, s in K.TIER_SIZE.items()])
    return fit.select(F.inline(one)).groupBy("tier").agg(F.round(F.sum("s") / 3600, 2).alias("hours"))


@query("LD-01_dataset_rows", f"WITH {ALL}, {_FINAL} SELECT sample_id, config, task_group FROM fin WHERE split = 'train' AND qc_train AND tier IN ('S', 'M') AND task_group IN ('T1', 'T3')")
def dataset_rows(spark, d):
    return finals(spark, d).where((F.col("split") == "train") & F.col("qc_train") & F.col("tier").isin("S", "M") & F.col("task_group").isin("T1", "T3")).select("sample_id", "config", "task_group")


@query("LD-03_nested_subsets", f"WITH {ALL}, {_FINAL}, s AS (SELECT DISTINCT sample_id, tier, family, split FROM fin), k AS (SELECT *, row_number() OVER (PARTITION BY tier, family, split ORDER BY sha256('subset|' || sample_id), sample_id) AS n, count(*) OVER (PARTITION BY tier, family, split) AS m FROM s) SELECT sample_id, n <= ceil(m * 0.1) AS mini, n <= ceil(m * 0.5) AS core FROM k")
def subsets(spark, d):
    s = finals(spark, d).select("sample_id", "tier", "family", "split").distinct()
    w = Window.partitionBy("tier", "family", "split")
    n, m = F.row_number().over(w.orderBy(F.sha2(F.concat_ws("|", F.lit("subset"), "sample_id"), 256), "sample_id")), F.count(F.lit(1)).over(w)
    return s.select("sample_id", n.alias("n"), m.alias("m")).select("sample_id", (F.col("n") <= F.ceil(F.col("m") * 0.1)).alias("mini"), (F.col("n") <= F.ceil(F.col("m") * 0.5)).alias("core"))
