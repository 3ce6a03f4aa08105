"""Queries on configurations, validation, sinks, builds and the remaining metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import build as B
from ..operators import index as I
from ..operators import resistance as R
from ..operators import validate as V
from ..operators.shared import shared_folder
from ..sources import config as Y
from ..sources import fixtures as X
from ..sources import sinks as W
from ..sources import tables as T
from .network import _PAIR, paired
from .registry import query
from .surfaces import surface_sql

LOADED = Y.load_tables()
DEFAULTS = Y.load_sources()


# -- configurations -------------------------------------------------------------------


@query("SRC-10_loaded_tables", f"WITH {X.CELLS}, {surface_sql(LOADED)} SELECT sid, r, c, table_id, nodata, round(CAST(resistance AS DOUBLE), 3) AS resistance FROM surface")
def loaded_tables(spark, d):
    """Cells under the tables of the YAML folder."""
    s = R.apply_tables(X.cells(spark, d), Y.load_tables())
    return s.select("sid", "r", "c", "table_id", "nodata", F.round(F.col("resistance").cast("double"), 3).alias("resistance"))


def _value(config: dict, place: tuple):
    for k in place:
        config = config[k]
    return float(config)


@query("SRC-11_source_config", "SELECT tier, key, base * pow(size // 128, power) AS pixels FROM (VALUES " + ", ".join(f"('{t}', {s})" for t, s in K.TIER_SIZE.items()) + ") t(tier, size), (VALUES " + ", ".join(f"('{'.'.join(p)}', {_value(DEFAULTS, p)}::DOUBLE, {n})" for p, n in Y.SCALED.items()) + ") k(key, base, power)")
def source_config(spark, d):
    """Pixel quantities of the source configuration, scaled for every tier."""
    rows = [(t, ".".join(p), _value(Y.for_tier(Y.load_sources(), t), p)) for t in K.TIER_SIZE for p in Y.SCALED]
    return spark.createDataFrame(rows, "tier string, key string, pixels double")


@query("G-16_presets", "SELECT * FROM (VALUES ('exact', 'direct', false), ('four_neighbours', 'multigrid', true)) t(name, method, four)")
def presets(spark, d):
    return spark.createDataFrame([(p.name, p.method, p.four) for p in Y.presets().values()], "name string, method string, four boolean")


@query("P-21_table_rules", """WITH t AS (SELECT p_partkey AS id, CAST(p_size - 2 AS DOUBLE) AS r_max, [CAST(p_partkey % 9 AS DOUBLE), CAST(p_size % 20 + 1 AS DOUBLE)] AS vs, [p_partkey % 7, p_size % 5 + 1] AS rs, [p_partkey % 50 + 0.0, p_size + 10.0] AS bs, CASE p_partkey % 3 WHEN 0 THEN 'barrier' WHEN 1 THEN 'nodata' ELSE 'table' END AS water, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size % 6 AS DOUBLE) END AS barrier FROM part)
SELECT id, concat_ws(',', CASE WHEN NOT r_max > 1 THEN 'r_max' END, CASE WHEN len([v FOR v IN vs IF NOT (v >= 1 AND v <= r_max)]) > 0 THEN 'landcover' END, CASE WHEN len([c FOR c IN rs IF c < 1 OR c > 5]) > 0 THEN 'roads' END, CASE WHEN bs[1] > bs[2] THEN 'bands' END, CASE WHEN water = 'barrier' AND NOT coalesce(barrier >= 1, false) THEN 'barrier' END) AS rules FROM t""")
def table_rules(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    x = lambda c: c.cast("double")
    water = F.when(p % 3 == 0, "barrier").when(p % 3 == 1, "nodata").otherwise("table")
    t = X.table(spark, d, "part").select(p.alias("id"), x(s - 2).alias("r_max"), F.array(x(p % 9), x(s % 20 + 1)).alias("class_values"), F.array((p % 7).cast("bigint"), (s % 5 + 1).cast("bigint")).alias("road_classes"), F.array(x(p % 50), x(s + 10)).alias("bands"), water.alias("water"), F.when(p % 4 != 0, x(s % 6)).alias("barrier"))
    return V.table_rules(t)


# -- validation -----------------------------------------------------------------------


@query("V-01_root_attributes", """WITH s AS (SELECT s_suppkey AS shard, CASE WHEN s_suppkey % 3 = 0 THEN '0.1' WHEN s_suppkey % 3 = 1 THEN '0.2' ELSE '9.9' END AS v FROM supplier)
SELECT shard, 'error' AS level, 'missing created_at' AS message FROM s WHERE shard % 5 = 0 UNION ALL SELECT shard, 'error', 'missing schema_version' FROM s WHERE shard % 7 = 0
UNION ALL SELECT shard, 'warning', 'schema_version ' || CASE WHEN shard % 7 = 0 THEN 'none' ELSE v END FROM s WHERE shard % 7 = 0 OR v = '9.9'""")
def root_attributes(spark, d):
    k = F.col("s_suppkey")
    version = F.when(k % 3 == 0, "0.1").when(k % 3 == 1, "0.2").otherwise("9.9")
    pair = lambda n, v: F.struct(F.lit(n).alias("k"), v.alias("v"))
    attrs = F.map_from_entries(F.array_compact(F.array(pair("dataset_version", F.lit("1.0")), pair("pipeline_git_sha", F.lit("0")), F.when(k % 7 != 0, pair("schema_version", version)), F.when(k % 5 != 0, pair("created_at", F.lit("2020"))))))
    return V.root_attributes(X.table(spark, d, "supplier").select(k.alias("shard"), attrs.alias("attrs")))


_NEED = ", ".join(f"('{kind}', '{n}', '{t}', {i}, {str(n in K.RASTERS).lower()})" for kind, ds in K.DATASETS.items() for i, (n, t) in enumerate(ds.items()))
_FOUND = f"""{X.INDEX}, need(kind, dataset, want, i, raster) AS (VALUES {_NEED}), ask AS (SELECT sample_id, config, kind, dataset, want, raster, sample_id + i AS z FROM idx JOIN need USING (kind)),
err AS (SELECT sample_id, config, dataset, CASE WHEN z % 13 = 0 THEN ['missing'] ELSE list_filter([CASE WHEN z % 17 = 0 THEN 'dtype' END, CASE WHEN raster AND z % 19 = 0 THEN 'shape' END, CASE WHEN z % 23 = 0 THEN 'not_finite' END], lambda x: x IS NOT NULL) END AS codes FROM ask)"""


def _datasets(spark, d):
    """What the index's configurations have stored: some arrays lack, have another type or shape, or bad values."""
    i = X.index(spark, d).withColumn("h", F.lit(128)).withColumn("w", F.lit(128))
    needs = F.create_map(*[x for kind, ds in K.DATASETS.items() for x in (F.lit(kind), F.array(*[F.struct(F.lit(n).alias("dataset"), F.lit(t).alias("want"), F.lit(k).alias("i")) for k, (n, t) in enumerate(ds.items())]))])
    asked = i.select("sample_id", "config", F.inline(F.element_at(needs, F.col("kind")))).withColumn("z", F.col("sample_id") + F.col("i")).where("z % 13 <> 0")
    z = F.col("z")
    found = asked.select("sample_id", "config", "dataset", F.when(z % 17 == 0, "int64").otherwise(F.col("want")).alias("dtype"), F.when(z % 19 == 0, 64).otherwise(128).alias("h"), F.lit(128).alias("w"), F.when(z % 23 == 0, 5).otherwise(0).alias("n_bad"))
    return i, found


@query("H-01_dataset_checks", f"WITH {_FOUND} SELECT sample_id, config, dataset, unnest(codes) AS code FROM err")
def dataset_checks(spark, d):
    return V.datasets(*_datasets(spark, d))


@query("H-02_validation_report", f"WITH {_FOUND}, e AS (SELECT sample_id, config, CAST(sum(len(codes)) AS BIGINT) AS n FROM err GROUP BY ALL) SELECT tier, count(DISTINCT sample_id) AS n_samples, count(*) AS n_configs, CAST(sum(n) AS BIGINT) AS n_errors, sum(n) = 0 AS ok FROM idx JOIN e USING (sample_id, config) GROUP BY tier")
def validation_report(spark, d):
    i, found = _datasets(spark, d)
    return V.report(i, V.datasets(i, found), "tier")


# -- sinks ----------------------------------------------------------------------------

_ASC = f"{X.CELLS}, l AS (SELECT sid, r, string_agg(coalesce(CAST(elevation AS VARCHAR), '-9999'), ' ' ORDER BY c) AS t FROM cells GROUP BY sid, r), g AS (SELECT sid, 'ncols 32' || chr(10) || 'nrows 32' || chr(10) || 'xllcorner 0' || chr(10) || 'yllcorner 0' || chr(10) || 'cellsize 100' || chr(10) || 'NODATA_value -9999' || chr(10) || string_agg(t, chr(10) ORDER BY r) || chr(10) AS grid FROM l GROUP BY sid)"


@query("SNK-17_ascii_grids", f"WITH {_ASC} SELECT sid, length(grid) AS size, sha256(grid) AS digest FROM g")
def ascii_grids(spark, d):
    return W.ascii_grids(X.cells(spark, d), "elevation").select("sid", F.length("grid").cast("bigint").alias("size"), F.sha2("grid", 256).alias("digest"))


@query("SRC-13_read_ascii_grids", f"WITH {X.CELLS} SELECT sid, r, c, CAST(elevation AS DOUBLE) AS value FROM cells")
def read_ascii_grids(spark, d):
    """Grids written as files and read again."""
    folder = shared_folder(spark, "grids")
    W.write_ascii_grids(X.cells(spark, d), "elevation", folder)
    g = T.ascii_grid(spark, f"{folder}/*")
    return g.select(F.regexp_extract("path", r"sid=(\d+)", 1).cast("bigint").alias("sid"), "r", "c", "value")


@query("SNK-03_array_archives", f"WITH {X.GRIDS} SELECT sid, count(*) AS cells, round(sum(v * (r * 8 + c)), 6) AS moment, '{{\"arrays\": [\"v\"], \"h\": 8, \"w\": 8}}' AS meta FROM grids GROUP BY sid")
def array_archives(spark, d):
    """Rasters packed as NPZ files with their description, and unpacked."""
    a = W.array_archives(X.grids(spark, d).select("sid", "r", "c", "v"), "v")
    back = W.read_archives(a.select("sid", "npz"), "v").groupBy("sid").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(F.col("v") * (F.col("r") * 8 + F.col("c"))), 6).alias("moment"))
    return back.join(a.select("sid", "meta"), "sid")


@query("SNK-04_input_shards", f"WITH {X.INDEX}, m AS (SELECT DISTINCT sample_id, sample_id // 50 AS shard FROM idx) SELECT shard, count(*) AS planned, count(*) FILTER (sample_id % 61 <> 7) AS present, bool_and(sample_id % 61 <> 7) AS complete FROM m GROUP BY shard")
def input_shards(spark, d):
    """A shard is written again unless every sample of its plan is there."""
    m = X.index(spark, d).select("sample_id", F.expr("sample_id DIV 50").alias("shard")).distinct()
    done = m.where("sample_id % 61 <> 7").select("sample_id", F.lit(True).alias("there"))
    g = m.join(done, "sample_id", "left").groupBy("shard").agg(F.count(F.lit(1)).alias("planned"), F.count("there").alias("present"))
    return g.withColumn("complete", F.col("planned") == F.col("present"))


_CARD = "CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'sc:Integer' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'sc:Float' WHEN column_type = 'DATE' THEN 'sc:Date' WHEN column_type LIKE 'TIMESTAMP%' THEN 'sc:DateTime' WHEN column_type = 'BOOLEAN' THEN 'sc:Boolean' ELSE 'sc:Text' END"


@query("SNK-14_card_fields", " UNION ALL ".join(f"SELECT '{t}' AS record_set, column_name AS name, {_CARD} AS data_type FROM (DESCRIBE SELECT * FROM {t})" for t in ("orders", "events")))
def card_fields(spark, d):
    """The fields of a dataset card over two tables."""
    made = W.card("build", "1.0", "https://creativecommons.org/licenses/by/4.0/", {t: X.table(spark, d, t).schema for t in ("orders", "events")}, {t: f"{t}.parquet" for t in ("orders", "events")})
    rows = [(r["name"], f["name"], f["dataType"]) for r in made["recordSet"] for f in r["field"]]
    return spark.createDataFrame(rows, "record_set string, name string, data_type string")


@query("SNK-15_schema_lines", "SELECT '| `' || column_name || '` | ' || CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END || ' | optional |  |' AS line FROM (DESCRIBE SELECT * FROM nation)")
def schema_lines(spark, d):
    """The fields of a schema page."""
    page = W.schema_page("nation", X.table(spark, d, "nation").schema)
    return spark.createDataFrame([(x,) for x in page.split("\n") if x.startswith("| `")], "line string")


@query("SNK-18_summary_lines", f"WITH {X.INDEX}, s AS (SELECT kind, tier, count(*) AS n FROM idx GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY kind, tier) - 1 AS INTEGER) AS no, '| ' || kind || ' | ' || tier || ' | ' || n || ' |' AS line FROM s UNION ALL SELECT -2, '| kind | tier | n |' UNION ALL SELECT -1, '|---|---|---|'")
def summary_lines(spark, d):
    return W.markdown(X.index(spark, d).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n")), "kind", "tier")


@query("SRC-17_located_sources", "SELECT name FROM (VALUES ('conversations.parquet'), ('customer.parquet')) t(name)")
def located(spark, d):
    return spark.createDataFrame([(n,) for n in W.located(spark, d, "c*.parquet")], "name string")


# -- plans ----------------------------------------------------------------------------


@query("M-04_manifest_specs", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS contrast FROM orders")
def manifest_specs(spark, d):
    """Numbers that are not numbers in a manifest are none in its specifications."""
    m = X.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double")).alias("contrast"))
    return W.null_for_nan(m)


_MS = {t: round(1000 * s) for t, s in K.COST_SECONDS["points"].items()}


@query("M-08_weighted_shards", f"WITH {X.INDEX}, c AS (SELECT sample_id, config, tier, sample_id // 1000 AS part, {X.case('tier', _MS)} AS ms FROM idx) SELECT sample_id, config, CAST(floor((sum(ms) OVER w - ms) / 60000) AS BIGINT) AS shard FROM c WINDOW w AS (PARTITION BY tier, part ORDER BY sample_id, config)")
def weighted(spark, d):
    """Samples in runs of a minute's solving, by tier and thousands of samples."""
    i = X.index(spark, d).select("sample_id", "config", "tier", F.expr("sample_id DIV 1000").alias("part"))
    return W.weighted_shards(i, I.mapped(_MS, F.col("tier")), 60000, ["tier", "part"], ["sample_id", "config"]).select("sample_id", "config", "shard")


@query("M-06_build_status", f"WITH {X.SEEDS} SELECT seed // 50 AS shard, count(*) AS manifest, count(*) AS inputs, count(*) AS outputs, count(*) AS index FROM seeds GROUP BY 1")
def build_status(spark, d):
    """A build of one landscape a seed, from plan to index."""
    root = shared_folder(spark, "build")
    B.plan(X.seeds(spark, d), root)
    B.prepare(spark, root)
    B.solve(spark, root)
    B.finalize(spark, root)
    return B.status(spark, root)


# -- metrics --------------------------------------------------------------------------


@query("MX-03_rank_agreement", f"""WITH {X.GRIDS}, {_PAIR}, k AS (SELECT *, rank() OVER (PARTITION BY sid ORDER BY x) AS rx, rank() OVER (PARTITION BY sid ORDER BY y) AS ry FROM pr),
n AS (SELECT sid, r, arg_min(c, x) AS nx, arg_min(c, y) AS ny FROM pr GROUP BY sid, r), a AS (SELECT sid, avg(CAST(nx = ny AS DOUBLE)) AS nearest FROM n GROUP BY sid)
SELECT sid, round(corr(rx, ry), 6) AS spearman, round(max(nearest), 6) AS nearest FROM k JOIN a USING (sid) GROUP BY sid""")
def rank_agreement(spark, d):
    """Correlation of ranks, and how often a row's nearest column is the same by both."""
    p = paired(spark, d)
    w = Window.partitionBy("sid")
    k = p.withColumn("rx", F.rank().over(w.orderBy("x"))).withColumn("ry", F.rank().over(w.orderBy("y")))
    n = p.groupBy("sid", "r").agg((F.min_by("c", "x") == F.min_by("c", "y")).cast("double").alias("same")).groupBy("sid").agg(F.round(F.avg("same"), 6).alias("nearest"))
    return k.groupBy("sid").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman")).join(n, "sid")


_SSIM = f"""{_PAIR}, a AS (SELECT *, x * x AS xx, y * y AS yy, x * y AS xy FROM pr),
h AS (SELECT sid, r, c, {', '.join(f'sum({v}) OVER w AS {v}' for v in ('x', 'y', 'xx', 'yy', 'xy'))}, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY sid, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
v AS (SELECT sid, {', '.join(f'sum({v}) OVER w / sum(n) OVER w AS {v}' for v in ('x', 'y', 'xx', 'yy', 'xy'))} FROM h WINDOW w AS (PARTITION BY sid, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query("MX-05_structural_similarity", f"WITH {X.GRIDS}, {_SSIM} SELECT sid, round(avg((2 * x * y + 0.0001) * (2 * (xy - x * y) + 0.0009) / ((x * x + y * y + 0.0001) * (xx - x * x + yy - y * y + 0.0009))), 5) AS ssim FROM v GROUP BY sid")
def similarity(spark, d):
    return I.structural_similarity(paired(spark, d), "x", "y").select("sid", F.round("ssim", 5).alias("ssim"))
