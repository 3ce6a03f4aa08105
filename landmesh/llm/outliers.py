"""Quality rules: robust multivariate outliers of text statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SPACE = r"[\x20\x09-\x0D]+"
GROUP = ("lang", "source")
#: What parameters are estimated for: a group (level 0), a language (1), all rows (2).
KEY = ("level", *GROUP)
#: Chi-square quantiles for five dimensions and the matching consistency factors of
#: truncated covariances (fixed values): share 0.75, share 0.975, and the rejection limit.
CHI_75, FACTOR_75 = 6.62568, 1.41246
CHI_975, FACTOR_975 = 12.83250, 1.08059
#: The squared distance over which a document goes. Clean texts' statistics have heavier
#: tails than a normal's, whose quantile of 0.975 in five dimensions is 12.8: on sf0.1 some
#: 220 documents lie between the two. 60 is where a normal leaves one in 10 ** 11.
LIMIT = 60.0
#: Standard deviations that measure nothing are not taken to be smaller than these.
FLOORS = (0.25, 0.05, 0.02, 0.1, 0.1)
P = len(FLOORS)
#: Parts that a group's rows are dealt to in joins.
SALTS = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the list.

    Each window is one number: the leading bits of its hash, then its place. Equal
    windows are neighbours after sorting; their words are compared to be sure.
    """

    def of(w):
        n = F.size(w)
        bits = F.length(F.bin(n))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

        def key(i):
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint"))

        def places(s):
            def pair(x, y):
                a, b = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
                same = x.bitwiseAND(F.bitwise_not(mask)) == y.bitwiseAND(F.bitwise_not(mask))
                for k in range(3):
                    same &= F.get(w, a + k) == F.get(w, b + k)
                return F.when(same, F.array(a, b))

            twins = F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), pair), lambda x: x.isNotNull())
            return F.sort_array(F.array_distinct(F.flatten(twins)))

        def covered(p):
            gaps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(3)))
            return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda t, x: t + x))

        sorted_keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))
        return F.when(n < 4, F.lit(0)).otherwise(_let(sorted_keys, lambda s: _let(places(s), covered)))

    return _let(words, of)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and whole-text statistics (a null text has no words).

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines,
    n_repeat_words, and base_failed: under 50 words, or over half in repeated windows.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", *GROUP, text.alias("t"))

    def of(w):
        lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), n_lines.alias("l"), _repeat_words(w).alias("n_repeat_words"))

    s = _let(F.array_remove(F.split("t", SPACE), ""), of)
    d = d.select("doc_id", *GROUP, s.alias("s"), F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    long = [F.col(x).cast("bigint").alias(n) for x, n in (("s.n_words", "n_words"), ("s.word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("s.l.n", "n_lines"), ("s.l.dup", "n_dup_lines"), ("s.n_repeat_words", "n_repeat_words"))]
    d = d.select("doc_id", *GROUP, *long)
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    """Add x0 to x4: what counts and shares become before they are compared."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    xs = (
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log((F.col("n_repeat_words") + 10) / (n * n / 2000 + 10)),
    )
    return stats.withColumns({f"x{i}": F.round(x, 9) for i, x in enumerate(xs)})


def _with(rows: DataFrame, params: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Join each row with the parameters of its ``key``; null is a group of its own.

    Rows of documents are dealt by group and a hash of their id against ``SALTS`` copies
    of the few parameters, so a group of any size spreads over as many tasks.
    """
    params = params.withColumnsRenamed({g: f"_{g}" for g in key})
    same = F.lit(True)
    for g in key:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    if "doc_id" in rows.columns:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        params = params.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.col("_salt") == F.col("_copy")
    return rows.join(params, same, "left").drop("_salt", "_copy", *[f"_{g}" for g in key])


def _levels(rows: DataFrame, least_rows: int) -> DataFrame:
    """The finest level at which each group has ``least_rows`` rows, else the last; and the pooled levels that its rows count in."""
    w = lambda *by: Window.partitionBy(*by)
    g = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("of_lang", F.sum("n").over(w("lang")))
    g = g.withColumn("_level", F.when(F.col("n") >= least_rows, 0).when(F.col("of_lang") >= least_rows, 1).otherwise(2))
    used = [F.when(F.col("_level") == 0, 0), F.when(F.max(F.col("_level") == 1).over(w("lang")), 1), F.when(F.max(F.col("_level") == 2).over(w(F.lit(0))), 2)]
    return materialize(g.select(*GROUP, "_level", F.array_compact(F.array(*used)).alias("_used")), "levels")


def _at(level: Column) -> list[Column]:
    """The key of a row at ``level``."""
    return [level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level < 1, F.col("source")).alias("source")]


def _centres(rows: DataFrame, width: float = 0.01) -> DataFrame:
    """Medians and median absolute deviations per group and coordinate, from counts of cells of ``width``."""

    def medians(values: DataFrame, name: str) -> DataFrame:
        cells = values.groupBy(*KEY, "j", F.floor(F.col("v") / width).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(*KEY, "j")
        up = w.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("u", F.sum("n").over(up)).withColumn("all", F.sum("n").over(w))
        got = cells.where(2 * F.col("u") >= F.col("all")).groupBy(*KEY, "j").agg(((F.min("c") + 0.5) * width).alias("v"))
        return got.groupBy(*KEY).agg(*[F.max(F.when(F.col("j") == i, F.col("v"))).alias(f"{name}{i}") for i in range(P)])

    def long(df: DataFrame, expr) -> DataFrame:
        return df.select("doc_id", *KEY, F.posexplode(F.array(*[expr(i) for i in range(P)])).alias("j", "v"))

    med = materialize(medians(long(rows, lambda i: F.col(f"x{i}")), "m"), "medians")
    dev = medians(long(_with(rows, med), lambda i: F.abs(F.col(f"x{i}") - F.col(f"m{i}"))), "s")
    return materialize(_with(med, dev), "scales")


def _starts(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Each row once for each start: how far it lies from the medians, in deviations, by three norms."""
    far = lambda i: F.abs(F.col(f"x{i}") - F.col(f"m{i}")) / F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), F.lit(2.0)) + FLOORS[i] ** 2)
    z = [far(i) for i in range(P)]
    norms = F.array(sum((x * x for x in z[1:]), z[0] * z[0]), sum(z[1:], z[0]), F.greatest(*z))
    return _with(rows, scales).select("doc_id", *KEY, *[f"x{i}" for i in range(P)], F.posexplode(norms).alias("start", "d2"))


def _distance(factor: float = 1.0) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    for i in range(P):
        part = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            part = part - F.col(f"l{i}_{k}") * y[k]
        y.append(part / F.col(f"l{i}_{i}"))
    total = y[0] * y[0]
    for c in y[1:]:
        total = total + c * c
    return total / F.lit(factor)


def _estimate(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """Mean and Cholesky factor of the scatter of each group's rows, and the logarithm of its determinant.

    Groups are told apart by the key and by ``more`` columns.
    """
    key = (*KEY, *more)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(P)]]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{k}")).alias(f"b{i}_{k}") for i in range(P) for k in range(i + 1)]
    g = rows.groupBy(*key).agg(*sums)
    g = g.withColumns({f"m{i}": F.round(F.col(f"a{i}") / F.col("n"), 9) for i in range(P)})
    for i in range(P):
        for k in range(i + 1):
            c = F.round(F.col(f"b{i}_{k}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{k}"), 9)
            if i == k:
                c = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2
            for j in range(k):
                c = c - F.col(f"l{i}_{j}") * F.col(f"l{k}_{j}")
            g = g.withColumn(f"l{i}_{k}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == k else c / F.col(f"l{k}_{k}"))
    det = F.round(2 * sum((F.log(f"l{i}_{i}") for i in range(1, P)), F.log("l0_0")), 9)
    return materialize(g.select(*key, *[f"m{i}" for i in range(P)], *[f"l{i}_{k}" for i in range(P) for k in range(i + 1)], det.alias("det")), name)


def _nearest(rows: DataFrame, share: float, *more: str) -> DataFrame:
    """Of each group, the rows nearest to its centre: the cells of distance ``d2`` that hold ``share`` of them."""
    key = (*KEY, *more)
    cell = F.floor(64 * F.log2(1 + F.col("d2")))
    placed = rows.withColumn("_c", cell)
    cells = placed.groupBy(*key, "_c").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key)
    up = w.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("u", F.sum("n").over(up)).withColumn("all", F.sum("n").over(w))
    last = cells.where(F.col("u") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*key).agg(F.min("_c").alias("_last"))
    return _with(placed, last, key).where(F.col("_c") <= F.col("_last"))


def _smallest_determinant(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """Minimum covariance determinant: parameters of the ``share`` of each group's rows whose scatter is smallest.

    From each start one concentration step is taken; the start of the smallest
    determinant goes on, with steps until no group's determinant falls, ``steps`` at most.
    A step picks the rows nearest by the last estimate and never raises the determinant
    but for the width of the cells that it counts in, so the smaller one is kept.
    """
    xs = [f"x{i}" for i in range(P)]
    first = _estimate(_nearest(_starts(rows, _centres(rows)), share, "start"), "starts", "start")
    near = _nearest(_with(rows, first).withColumn("d2", _distance()), share, "start")
    tried = _estimate(near, "tried", "start")
    names = [c for c in tried.columns if c not in (*KEY, "start")]
    params = materialize(tried.groupBy(*KEY).agg(F.min(F.struct("det", "start", *[c for c in names if c != "det"])).alias("p")).select(*KEY, *[F.col(f"p.{c}").alias(c) for c in names]), "best")
    for k in range(steps):
        near = _nearest(_with(rows, params).withColumn("d2", _distance()), share).select("doc_id", *KEY, *xs)
        both = params.unionByName(_estimate(near, f"step{k}"))
        fewer = both.groupBy(*KEY).agg(F.min(F.struct("det", *[c for c in names if c != "det"])).alias("p"), F.min("det").alias("_d"))
        before = params.select(*KEY, F.col("det").alias("was"))
        fewer = materialize(_with(fewer, before).withColumn("gain", F.col("was") - F.col("_d")), f"fewer{k}")
        params = fewer.select(*KEY, *[F.col(f"p.{c}").alias(c) for c in names])
        if (fewer.agg(F.max("gain")).first()[0] or 0.0) < 1e-3:
            break
    return params


def reject_outliers(docs: DataFrame, limit: float = LIMIT, share: float = 0.75, steps: int = 8, least_rows: int = 50) -> DataFrame:
    """Base rules, then robust distances per language and source.

    Minimum covariance determinant of the ``share`` of rows whose scatter is smallest,
    from three starts by concentration steps, ``steps`` at most after the first; one
    reweighting step follows. Documents that pass the base rules are kept if their
    squared Mahalanobis distance is at most ``limit``. Groups of fewer than
    ``least_rows`` such documents are judged by the estimate of all rows of their
    language, or of the table if those are too few too.
    A null lang or source is a group of its own; each row is judged for itself, so
    repeated rows get the same verdict. Needs doc_id, text, lang, source; other
    columns are ignored. An empty table gives an empty result.
    Returns the statistics, distance2 (null if not computed), base_failed and kept.
    """
    stats = materialize(transformed(base_statistics(docs)), "statistics")
    xs = [f"x{i}" for i in range(P)]
    rows = stats.where(~F.col("base_failed")).select("doc_id", *GROUP, *xs)
    levels = _levels(rows, least_rows)
    rows = _with(rows, levels, GROUP).withColumn("_at", F.explode("_used")).select("doc_id", *_at(F.col("_at")), *xs)
    params = _smallest_determinant(rows, share, steps)
    core = _with(rows, params).where(_distance(FACTOR_75) <= CHI_975).select("doc_id", *KEY, *xs)
    params = _estimate(core, "reweighted")
    own = levels.select(*[F.col(g).alias(f"own_{g}") for g in GROUP], *_at(F.col("_level")))
    params = _with(own, params).drop(*KEY, "det").withColumnsRenamed({f"own_{g}": g for g in GROUP})
    judged = _with(stats, params, GROUP)
    d2 = F.when(~F.col("base_failed"), _distance(FACTOR_975))
    judged = judged.withColumn("distance2", d2)
    kept = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= limit))
    return judged.select("doc_id", *GROUP, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *xs, "distance2", "base_failed", kept.alias("kept"))


def query(spark, sf_dir):
    out = reject_outliers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
