"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from landmesh.llm import cotraining, exchange, jaccard, mixing, outliers, packing, substrings, tokens, topk, warc
from landmesh.llm.sharding import ShardedTable, arrive
from landmesh.llm.store import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("n_words", "size", "component_id", "kept", "length", "ids", "bucket", "chunk", "score", "sequence_id"):
            df = df.withColumn(c, F.lit("clash"))
    return df


LONG = words(60_000, 9)
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, words(300, 1), "en", "a", 5),
    (5, words(300, 1), None, "a", 5),
    (5, words(300, 1), None, "a", 5),
    (6, words(300, 1) + " tail", "en", "b", 5),
    (7, LONG, "en", "b", 5),
    (8, "one two", "en", "c", 5),
    (9, "One  two", "en", "c", 5),
    (None, words(80, 2), "en", "c", 5),
    (10, "é ü " * 30, "de", "\U0001f600", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS, extra=True).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_packing(docs, nothing):
    rows = packing.digest(docs).collect()
    enc = tokens.encoder("byte_bpe_50k")
    assert sum(r.length for r in rows) == sum(len(enc.encode(x[1])) + 1 for x in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert packing.digest(nothing).collect() == []


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["a  b", " a", "a ", "x\n y", "don't 12 34!? <|endoftext|> 　q 　", "\n\n", "日本 語\ttab", "a b  c d", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "<|endoftext", "a <|endoftext|> b"]


def test_encoder_equals_tokenizers():
    enc, texts = tokens.encoder("byte_bpe_50k"), [x[1] or "" for x in ROWS] + ODD
    for text, want in zip(texts, tokenizer().encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(text).tolist() == want.ids


def test_pieces_equal_tokenizers(spark):
    """Starts, lengths and checksums of all pieces, from the tokenizer's own ids."""
    texts = dict(enumerate([None, "", LONG, words(1023, 5), words(900, 6), *ODD]))
    rows = packing.digest(docs_of(spark, [(i, t, "en", "a", 1) for i, t in texts.items()]).repartition(3)).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for i, text in texts.items():
        ids = tokenizer().encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[a : head if k == 0 else a + 1024]
            want[i, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want


def test_sweep_matches_successors():
    """Item by item, from the longest: each takes the smallest slot that is free and fits."""
    r = random.Random(5)
    for _ in range(50):
        slots = sorted({r.randint(1, 40): r.randint(1, 4) for _ in range(8)}.items(), reverse=True)
        items = sorted({r.randint(1, 40): r.randint(1, 4) for _ in range(8)}.items(), reverse=True)
        events = sorted([(s, 0, 100 * s, 0, n) for s, n in slots] + [(s, 1, 0, n) for s, n in items], key=lambda e: (-e[0], *e[1:]))
        matches, left, _ = packing.sweep(events)
        free, got, missed = [s for s, n in slots for _ in range(n)], [], []
        for size, n in items:
            for _ in range(n):
                fit = [s for s in free if s >= size]
                if fit:
                    free.remove(min(fit))
                    got.append((size, min(fit)))
                else:
                    missed.append(size)
        assert sorted((m[0], m[3] // 100) for m in matches for _ in range(m[2])) == sorted(got)
        assert sorted(x for x, _, n in left for _ in range(n)) == sorted(missed)


def best_fit_decreasing(items, cap):
    gaps = []
    for x in sorted(items, reverse=True):
        fit = [g for g in gaps if g >= x]
        gaps.remove(min(fit)) if fit else None
        gaps.append((min(fit) if fit else cap) - x)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "halves", "small", "equal", "one"])
def test_supersteps_pack_well(spark, kind):
    r, cap = random.Random(5), 64
    items = {"mixed": [min(cap, 1 + int(r.expovariate(0.05))) for _ in range(1500)], "halves": [r.randint(16, 32) for _ in range(400)], "small": [r.randint(1, 5) for _ in range(900)], "equal": [21] * 300, "one": [cap]}[kind]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(items)], "doc_id bigint, piece int, length bigint").repartition(4)
    rows = packing.pack(df, cap).collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(len(items))) and all(items[r.doc_id] == r.length for r in rows)
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append(x)
    for seq in by.values():
        at = 0
        for x in sorted(seq, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= cap
    assert len(by) <= max(best_fit_decreasing(items, cap) * (1.15 if kind == "halves" else 1.01), -(-sum(items) // cap) + 1)


def test_histogram(docs, nothing):
    h = tokens.length_histogram(tokens.token_counts(docs)).toPandas().set_index("length")
    enc = tokens.encoder("byte_bpe_50k")
    n = np.array([len(enc.encode(x[1])) for x in ROWS])
    assert h.n_docs.sum() == len(n)
    for length, r in h.iterrows():
        assert r.docs_at_least == (n >= length).sum() and r.tokens_at_least == n[n >= length].sum() and r.truncated_total == np.minimum(n, length).sum()
    hist = tokens.length_histogram(tokens.token_counts(docs))
    assert tokens.truncated_totals(tokens.length_histogram(tokens.token_counts(nothing)), [5]).collect()[0].tokens_kept == 0
    assert tokens.length_quantiles(tokens.length_histogram(tokens.token_counts(nothing)), [0.5]).collect()[0].length is None
    for r in tokens.truncated_totals(hist, [0, 1, 99, 100, 10**6, *map(int, n)]).collect():
        assert (r.docs_cut, r.tokens_kept) == ((n > r.context).sum(), np.minimum(n, r.context).sum())
    for r in tokens.length_quantiles(hist, [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r.length == sorted(n)[max(1, int(np.ceil(r.share * len(n)))) - 1]
    assert tokens.length_histogram(tokens.token_counts(nothing)).collect() == []


def tie(text):
    """Spark's xxhash64 of a string: the order of rows that share an id."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def naive_cut(rows, size):
    seen, out = {}, {}
    for k, (i, text, *_) in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, tie(x[1])))):
        w = split(text)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.setdefault(key, (k, s))
        out.setdefault(i, []).append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return {i: sorted(v) for i, v in out.items()}


def cut_of(rows, words="n_words", removed="n_removed"):
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r[words], r[removed], " ".join(split(r.text))))
    return {i: sorted(v) for i, v in got.items()}


def test_substrings(docs, nothing):
    rows = substrings.drop_repeats(docs, 20).collect()
    assert cut_of(rows, "repeats_n_words") == naive_cut(ROWS, 20)
    assert all(r.component_id == "clash" and r.n_words == "clash" for r in rows)
    texts = {i: t for i, t, *_ in ROWS if i != 5}
    assert all(r.text == texts[r.doc_id] for r in rows if r.n_removed == 0 and r.doc_id != 5)
    assert substrings.drop_repeats(docs, 20, counts=None).columns == docs.columns
    assert substrings.drop_repeats(nothing).collect() == []


def test_substrings_random(spark):
    rows = [(i, words(random.Random(i).randint(0, 60), i % 40), "en", "a", 1) for i in range(150)]
    rows += [(200 + i, words(30, 77) + " " + words(20, i) + " " + words(30, 78), "en", "a", 1) for i in range(40)]
    rows += [(None, words(40, i % 45), "en", "a", 1) for i in range(60)] + [(7, words(40, 50 + i % 10), "en", "a", 1) for i in range(20)]
    df = docs_of(spark, rows).repartition(5)
    assert cut_of(substrings.drop_repeats(df, 8, chunk_bytes=500).collect()) == naive_cut(rows, 8)


@pytest.mark.parametrize("fan, group", [(8, 5), (64, 3)])
def test_exchange_in_two_steps(spark, monkeypatch, fan, group):
    """Buckets split in parts, their messages merged by groups of chunks: the same results."""
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(exchange, "GROUP", group)
    monkeypatch.setattr(exchange, "BUCKET_WINDOWS", 8)
    rows = [(i, words(random.Random(i).randint(0, 60), i % 40), "en", "a", 1) for i in range(120)]
    rows += [(200 + i, words(30, 77) + " " + words(20, i) + " " + words(30, 78), "en", "a", 1) for i in range(30)] + [(None, words(40, i % 45), "en", "a", 1) for i in range(30)]
    df = docs_of(spark, rows).repartition(5)
    assert exchange.plan(df, chunk_bytes=500).parts > 1
    assert cut_of(substrings.drop_repeats(df, 8, chunk_bytes=500).collect()) == naive_cut(rows, 8)
    known = [x for x in rows if x[0] is not None]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs_of(spark, known)).collect()} == naive_components(known)


def test_substrings_keep_all_other_text(spark):
    assert substrings.without("a\n\nb  c d\te", np.array([0, 1, 1, 0, 0], bool)) == "a d\te"
    assert substrings.without(" a b\nc", np.array([1, 1, 0], bool)) == "c"
    assert substrings.without("a b\nc\n", np.array([0, 0, 1], bool)) == "a b\n"
    first, last = words(25, 1), words(25, 2)
    rows = [(1, first + "\n\n" + last, "en", "a", 1), (2, "x\n\n  y\n" + first + "\n\tz é\n", "en", "a", 1), (3, " \n q \n", "en", "a", 1)]
    got = {r.doc_id: r.text for r in substrings.drop_repeats(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "x\n\n  y\n\tz é\n", 3: " \n q \n"}


def thue_morse(n):
    """Two different words of n bytes that hash alike under any polynomial modulo 2**64, for n of 1024 and more."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 65, 1024, 2048, 4096, 8192])
def test_long_words_are_told_apart(spark, n):
    x, y = thue_morse(n)
    head, tail = words(19, 1), " a b c d"
    rows = [(1, f"{head} {x}", "en", "a", 1), (2, f"{head} {y}", "en", "a", 1), (3, x + tail, "en", "a", 1), (4, y + tail, "en", "a", 1), (5, x, "en", "a", 1), (6, y, "en", "a", 1)]
    df = docs_of(spark, rows)
    assert cut_of(substrings.drop_repeats(df).collect()) == naive_cut(rows, 20)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == naive_components(rows)


def test_sequences_of_two_words_are_told_apart():
    """Windows that are Thue-Morse sequences of words have different hashes, one and the other."""
    from landmesh.llm.words import buffers, window_hashes, word_hashes

    a, b = thue_morse(1024)
    texts = [" ".join(a), " ".join(b)]
    hashes, counts = word_hashes(*buffers(pa.array(texts)), ways=2)
    for size in (1, 2, 16, 20, 1024):
        got, starts, _ = window_hashes(hashes, counts, size)
        flat = [t for x in texts for t in x.split()]
        true = {tuple(flat[i : i + size]) for i in starts}
        assert len({int(x) for x in got[0]}) == len(true) == len({int(x) for x in got[1]})


def naive_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text, *_ in rows:
        w = split((text or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_edges(docs, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == naive_components([x for x in ROWS if x[0] is not None]) | {None: (76, None)}
    assert jaccard.join(nothing).collect() == []
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=lambda x: (x is None, x or 0)) == [1, 2, 3, 4, 7, 8, 10, None]


def test_jaccard_random(spark, monkeypatch):
    r = random.Random(1)
    rows, k = [], 0
    for family in range(12):
        base = split(words(60 + 10 * family, 1000 + family))
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            rows.append((k, " ".join(w), "en", "a", 1))
            k += 1
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs_of(spark, rows).repartition(4)).collect()}
    assert got == naive_components(rows)


def test_tree_loses_no_pair():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 90, r.integers(20, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for _ in range(120)]
    n = np.array([len(s) for s in sets])
    tree = jaccard.Tree(np.stack([jaccard.point(s) for s in sets]), n, 3, 4)
    got = {(min(a, b), max(a, b)) for i, j in tree.pairs(np.arange(len(n))) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    true = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n)) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (n[a] + n[b])}
    assert true <= got and len(got) < len(n) * (len(n) - 1) / 2


def test_mixing(docs, nothing, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id == 1} == {0}
    total = sum(r.size for r in rows)
    goals = {(r.source, r.source_size): r.target for r in rows}
    assert abs(sum(goals.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-6 for (_, s), t in goals.items()) and all(r.copies <= 2 for r in rows)
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns and applied.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing).collect() == [] and mixing.apply_mix(nothing).collect() == []
    many = docs_of(spark, [(i, words(5 + i % 50, i), "en", "abcd"[i % 4], 1) for i in range(2000)])
    near = mixing.mix(many).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r.t - r.k) <= 120 for r in near)


def test_outliers(docs, nothing, spark):
    rows = {r.doc_id: r for r in outliers.reject_outliers(docs).collect()}
    assert len(rows) == len({x[0] for x in ROWS}) and rows[1].n_words == 0 and not rows[1].kept and rows[4].kept
    assert outliers.reject_outliers(nothing).collect() == []
    plain = [(i, words(200 + i, i), "en", "a", 1) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in split(words(200, i))), "en", "a", 1) for i in range(5)]
    got = {r.doc_id: r.kept for r in outliers.reject_outliers(docs_of(spark, plain + junk)).collect()}
    assert not any(got[1000 + i] for i in range(5)) and sum(got[i] for i in range(200)) >= 198


def test_outliers_in_small_groups(spark):
    junk = lambda i, lang, source: (i, " ".join(w + "###" for w in split(words(200, i))), lang, source, 1)
    plain = [(i, words(200 + i, i), "en", f"s{i % 20}", 1) for i in range(200)] + [(300 + i, words(200 + i, i), "en", "big", 1) for i in range(60)]
    rare = [(400, words(220, 400), "xx", "rare", 1), (401, words(220, 401), None, None, 1)]
    bad = [junk(1000, "en", "s0"), junk(1001, "en", "only"), junk(1002, "xx", "rare"), junk(1003, None, None)]
    got = {r.doc_id: r for r in outliers.reject_outliers(docs_of(spark, plain + rare + bad)).collect()}
    assert len(got) == len(plain + rare + bad) and all(r.distance2 is not None for r in got.values() if not r.base_failed)
    assert not any(got[r[0]].kept for r in bad) and got[400].kept and got[401].kept and sum(got[r[0]].kept for r in plain) >= 255


def test_outliers_reach_the_smallest_determinant(spark):
    """Beside concentration steps from many random starts, on exact ranks, written from the definition."""
    rows = [(i, words(60 + 3 * i, i) + (" # $ %" * (i % 7)), "en", "a", 1) for i in range(160)]
    rows += [(200 + i, "\n".join(words(20, 900 + i // 9) for _ in range(3 + i % 5)) + words(60, i) + " ##" * 30, "en", "a", 1) for i in range(36)]
    p = outliers.reject_outliers(docs_of(spark, rows)).where("NOT base_failed").toPandas().sort_values("doc_id")
    x = p[[f"x{i}" for i in range(5)]].to_numpy()
    floor = np.diag(np.array(outliers.FLOORS) ** 2)
    h, rng_ = int(np.ceil(0.75 * len(x))), np.random.default_rng(0)
    scatter = lambda part: np.cov(part.T, bias=True) + floor
    far = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    best = (np.inf, None)
    for _ in range(100):
        part = x[rng_.choice(len(x), 6, replace=False)]
        for _ in range(30):
            part = x[np.argsort(far(part.mean(0), scatter(part)), kind="stable")[:h]]
        best = min(best, (np.linalg.slogdet(scatter(part))[1], part.tobytes()))
    part = np.frombuffer(best[1]).reshape(h, 5)
    core = x[far(part.mean(0), scatter(part)) / outliers.FACTOR_75 <= outliers.CHI_975]
    d2 = far(core.mean(0), scatter(core)) / outliers.FACTOR_975
    got = p.distance2.to_numpy()
    assert np.corrcoef(np.log1p(got), np.log1p(d2))[0, 1] > 0.995
    clear = (d2 < 45) | (d2 > 80)
    assert clear.mean() > 0.9 and ((got <= outliers.LIMIT) == (d2 <= outliers.LIMIT))[clear].all()


BASE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (SELECT unnest(range(3)) AS o) WHERE n > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
)
SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM t LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def test_base_statistics_equal_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    given = [tuple(r) for r in spark.read.parquet(path).where("length(text) < 30000").select("doc_id", "text").collect()]
    given = [(i, t) for i, (_, t) in enumerate(given)] + [(10_000 + i, x[1] if x[1] != LONG else LONG[:10_000]) for i, x in enumerate(ROWS)]
    given += [(20_000, "a b c a b c"), (20_001, "a b c b a"), (20_002, "x\n\nx\n y\n y\ny\n \n"), (20_003, "é#é *" * 40), (20_004, "a a a a")]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in given], "doc_id bigint, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in given], "text": [t for _, t in given]}))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(tuple(r) for r in outliers.base_statistics(df).select(*cols).collect())
    assert got == sorted(con.execute(BASE_SQL).fetchall())


def test_classifier(docs, nothing, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    assert cotraining.classify(docs, labels).where("NOT kept OR score IS NOT NULL").count() == 0
    assert cotraining.keep_good(docs, labels).count() == len(ROWS)
    good = [(i, words(80, i), "en", "ab"[i % 2], 500) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in split(words(80, i))), "en", "ab"[i % 2], 500) for i in range(100)]
    df = docs_of(spark, good + bad + ROWS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in cotraining.classify(df, labels).collect()}
    held = [got[i] for i in range(150, 300)] + [not got[1000 + i] for i in range(50, 100)]
    assert sum(held) / len(held) > 0.98
    assert cotraining.keep_good(df, labels).columns == df.columns
    assert cotraining.classify(nothing, labels).collect() == []


def test_classifier_equals_brute_force(spark):
    """All views in memory, each round's surest by sorting all unlabelled rows: the same models and scores."""
    r = random.Random(11)
    good = [(i, words(60 + i % 40, i), "en", "ab"[i % 2], 400 + i % 50) for i in range(160)]
    bad = [(1000 + i, " ".join(w.upper() if r.random() < 0.7 else w for w in split(words(60, i))), "de", "bc"[i % 2], 300 + i % 80) for i in range(80)]
    rows = good + bad
    labelled = {i: 1 for i in range(60)} | {1000 + i: 0 for i in range(30)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in labelled.items()], "doc_id bigint, quality int, toxic int")
    df = docs_of(spark, rows).repartition(3)
    batch = pa.RecordBatch.from_pandas(cotraining._views(df).toPandas().sort_values("doc_id"), preserve_index=False)
    ids = np.asarray(batch["doc_id"])
    views = (cotraining.text_view(batch["text"]), cotraining.meta_view(batch))
    y = np.array([labelled.get(int(i), -1) for i in ids])
    free = np.flatnonzero(y < 0)
    order = {int(x.doc_id): x.h for x in df.select("doc_id", F.xxhash64("doc_id", F.lit(2)).alias("h")).collect()}
    cut = np.log(0.97 / 0.03)

    def surest(models, taken):
        out = []
        for v in range(2):
            z = np.round(models[v].logit(views[v][free].astype(np.float32)), 6)
            z[np.isin(ids[free], taken[v])] = 0
            mine = []
            for sign, label in ((1, 1), (-1, 0)):
                far = sorted((-sign * z[k], order[int(ids[i])], i) for k, i in enumerate(free) if sign * z[k] >= cut)[:5]
                mine += [(ids[i], i, label) for _, _, i in far]
            mine.sort()
            at = np.array([i for _, i, _ in mine], int)
            out.append((ids[at], tuple(x[at] for x in views), np.array([g for _, _, g in mine], float)))
        return out

    has = np.flatnonzero(y >= 0)
    model = cotraining.cotrain(tuple(x[has] for x in views), y[has].astype(float), surest)
    want = dict(zip(ids.tolist(), model.scores(*views)[2], strict=True))
    got = {x.doc_id: x.score for x in cotraining.classify(df, labels, per_round=5).collect()}
    assert all(abs(got[i] - want[i]) < 1e-4 for i in want)
    assert np.mean([(got[i] >= 0.5) == (i < 1000) for i in got]) > 0.97


def test_classifier_draws_on_all_documents(spark):
    """The surest are found among all unlabelled documents: no pool of a fixed size."""
    df = docs_of(spark, [(i, "some words", "en", "a", 10 + i) for i in range(3000)]).repartition(5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2990, 3000)], "doc_id bigint, quality int, toxic int")
    at = lambda n: np.eye(n)[n - 2]
    m = [cotraining.Model(np.zeros(n), np.ones(n), np.r_[w * at(n), b]) for n, w, b in ((cotraining.N_TEXT, 0.0, 0.0), (cotraining.N_META, 100.0, -500.0))]
    taken = [np.zeros(0, np.int64), np.array([2989, 0])]
    got = cotraining.surest_ids(df, labels, m, taken, 1000, 0.97).collect()
    assert {r.doc_id for r in got if r.good} == set(range(1989, 2989)) and {r.doc_id for r in got if not r.good} <= set(range(1, 150))
    assert all(r.view == 1 for r in got)
    few = cotraining.surest_ids(df, labels, m, taken, 2, 0.97).collect()
    assert sorted((r.doc_id, r.good) for r in few) == [(1, 0), (2, 0), (2987, 1), (2988, 1)]


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0, 2.0]), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    q = topk.quantized(topk.usable(df, "embedding"), "embedding")
    got = {}
    for x in topk.search(q.where("vec_id % 50 = 0"), q, 5).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    v = {i: np.floor(256 * np.asarray(e, np.float32).astype(float)).astype(int) for i, e in rows if i is not None and e is not None and len(e) == 8 and all(x is not None and np.isfinite(x) for x in e)}
    for i in v:
        if i % 50 == 0:
            best = sorted(((-int(v[i] @ v[j]), j) for j in v if j != i))[:5]
            assert [got[i][k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert topk.search(q.where("false"), q, 5).collect() == []


def test_top_k_of_repeated_rows_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "SHARD", 2)
    rows = [(50, [1, 2]), (50, [3, 0]), (7, [5, 5]), (7, [5, 5]), (7, [0, 1]), (100, [2, 2]), (3, [1, 1, 1]), (0, [9, 9, 9]), (11, [-4, 0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<bigint>").repartition(2)
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df.where("vec_id % 50 = 0"), df, 3).collect()]
    assert sorted(got) == [(0, 1, 3, 27), (50, 1, 7, 15), (50, 2, 7, 15), (50, 3, 100, 6), (100, 1, 7, 20), (100, 2, 7, 20), (100, 3, 50, 6)]
    big = 3_000_000_000
    far = spark.createDataFrame([(50, [big, -big]), (1, [big, 0]), (2, [big - 1, 0]), (3, [0, big])], "vec_id bigint, embedding array<bigint>")
    got = [(x.vec_id, x.score) for x in topk.search(far.where("vec_id = 50"), far, 3).orderBy("rank").collect()]
    assert got == [(1, big * big), (2, big * (big - 1)), (3, -big * big)]
    over = spark.createDataFrame([(50, [1 << 40]), (1, [1 << 40])], "vec_id bigint, embedding array<bigint>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(over.where("vec_id = 50"), over, 3).collect()


def test_warc_round_trip(spark):
    big = "x" * 2000
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://c\r\nd", big), (4, "u", big), (5, "u", big), (6, "u", "s" * 10), (7, "u", "s" * 10), (8, "u", "é" * 600), (9, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = new_path(spark, "warc-test")
    assert sum(r.records for r in warc.write(pages, folder).collect()) == len(rows)
    got = {r.record_id: r for r in warc.read(spark, folder).collect()}
    assert len(got) == len(rows) and all(r.problem is None for r in got.values())
    for i, _, html in rows:
        r, payload = got[f"urn:page:{i}"], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", "urn:page:5") if i in (3, 4) else ("response", None))
        assert i in (3, 4) or r.payload == payload
    empty = new_path(spark, "warc-empty")
    warc.write(pages.where("false"), empty)
    assert warc.read(spark, empty).collect() == []


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage(gzip):
    r = random.Random(2)
    made = []
    for i in range(30):
        body = bytes(r.randrange(256) for _ in range(r.randint(0, 400)))
        one = warc.record("response", f"urn:page:{i}", "u", body, hashlib.sha1(body).hexdigest(), len(body), None)
        made.append(warc.member(one) if gzip else one)
    starts = np.cumsum([0, *map(len, made)])
    whole = b"".join(made)
    for hurt in ([], [3], [0, 1], [29], [5, 9, 10]):
        data = bytearray(whole)
        for k in hurt:
            at = starts[k] + len(made[k]) // 2
            for j in range(6):
                data[at + j] ^= 0x5A
        rows = list(warc.salvage(bytes(data), "p"))
        assert [x["record_id"] for x in rows if "record_id" in x] == [f"urn:page:{i}" for i in range(30) if i not in hurt]
        gaps = [(x["start"], x["stop"]) for x in rows if "problem" in x]
        runs = [k for k in hurt if k - 1 not in hurt]
        assert [a for a, _ in gaps] == [starts[k] for k in runs]
        assert sum(b - a for a, b in gaps) == sum(len(made[k]) for k in hurt)
    cut = whole[: starts[20] + 5]
    rows = list(warc.salvage(cut))
    assert sum("record_id" in x for x in rows) == 20 and rows[-1]["problem"] and rows[-1]["stop"] == len(cut)
    lost = whole[: starts[4] + 3] + whole[starts[6] :]
    assert [x["record_id"] for x in warc.salvage(lost) if "record_id" in x] == [f"urn:page:{i}" for i in range(30) if i not in (4, 5)]


def plain(i, body, digest=None, more="", kind="response"):
    """A record as other writers make it: base 32 digests, folded lines, any algorithm."""
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    said = f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\n{said}{more}Content-Type: application/http;\r\n msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def found(rows):
    return [r["record_id"] for r in rows if "record_id" in r]


def test_digests_and_headers_of_other_writers():
    body = b"<html>" * 50
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    for digest, good in [(f"sha1:{b32}", True), (f"SHA1:{b32.lower()}", True), ("sha256:" + hashlib.sha256(body).hexdigest(), True), ("blake9:zzz", True), ("sha1:short", False), (None, True), ("sha1:" + "A" * 32, False), ("md5:" + "0" * 32, False)]:
        rows = list(warc.salvage(plain(1, body, digest)))
        assert bool(found(rows)) == good, digest
        if good:
            assert rows[0]["payload"] == body and rows[0]["payload_digest"] == hashlib.sha1(body).hexdigest()
    far = "WARC-Target-URI: http://a/" + "x" * (2 << 20) + "\r\n"
    assert found(warc.salvage(plain(1, body, None, far))) == ["urn:page:1"]
    revisit = list(warc.salvage(plain(2, b"", f"sha1:{b32}", kind="revisit")))
    assert revisit[0]["payload_digest"] == hashlib.sha1(body).hexdigest()


@pytest.mark.parametrize("hold", [0, 1 << 20])
def test_records_inside_damaged_members(monkeypatch, hold):
    monkeypatch.setattr(warc, "HOLD", hold)
    r = random.Random(4)
    body = lambda i: bytes(random.Random(i).randrange(256) for _ in range(r.randint(50, 300)))
    one = [plain(i, b, "sha1:" + hashlib.sha1(b).hexdigest()) for i, b in ((i, body(i)) for i in range(50))]
    bad = one[20].replace(b"sha1:", b"sha1:00", 1).replace(one[20].split(b"sha1:")[1][:2], b"", 0)
    bad = re.sub(rb"sha1:00(.{38})..", rb"sha1:00\1", bad)
    whole = warc.member(b"".join(one[:20] + [bad] + one[21:]))
    rows = list(warc.salvage(whole + warc.member(one[0]), "p"))
    assert found(rows) == [f"urn:page:{i}" for i in range(50) if i != 20] + ["urn:page:0"]
    gap = [x for x in rows if "problem" in x]
    assert [(g["start"], g["stop"]) for g in gap] == [(0, len(whole))] and gap[0]["inner_start"] == sum(map(len, one[:20])) and "digest" in gap[0]["problem"]
    good = warc.member(b"".join(one))
    cut = list(warc.salvage(good[:-300], "p"))
    assert 40 < len(found(cut)) < 50 and cut[-1]["problem"] == "gzip: truncated member"
    crc = bytearray(good)
    crc[-6] ^= 1
    rows = list(warc.salvage(bytes(crc) + warc.member(one[3])))
    assert found(rows) == [f"urn:page:{i}" for i in range(50)] + ["urn:page:3"]
    nameless = warc.member(b"".join(plain(i, body(i)) for i in range(30)))
    crc = bytearray(nameless)
    crc[-6] ^= 1
    assert found(warc.salvage(bytes(crc))) == [] and len(found(warc.salvage(nameless[:-200]))) > 10


def test_archives_are_streamed(tmp_path):
    bodies = [random.Random(i).randbytes(200_000) for i in range(120)]
    path = tmp_path / "one.warc.gz"
    path.write_bytes(b"junk" + warc.member(b"".join(plain(i, b) for i, b in enumerate(bodies)), 1))
    with open(path, "rb") as f:
        rows = list(warc.salvage(f, "p", path.stat().st_size))
    assert [r["payload"] for r in rows if "payload" in r] == bodies and rows[-1]["stop"] == 4


def test_query_salvages_damaged_archives(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}", f"page {i} " * (i + 1)) for i in range(200)] + [(7, "http://7", "page 7 " * 8), (None, "u", "none"), (500, "u", "big " * 200_000)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    write = warc.write
    assert warc.query(spark, str(tmp_path)).count() == 203

    def hurt(pages, folder):
        out = write(pages.repartition(1), folder)
        path = out.first().path.removeprefix("file://")
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2 : len(data) // 2 + 40] = b"x" * 40
        open(path, "wb").write(bytes(data))
        open(path.replace("part-", "part-stale-"), "wb").write(bytes(data))
        return out

    logs = []
    place = warc.new_path
    monkeypatch.setattr(warc, "new_path", lambda s, n: logs.append(place(s, n)) or logs[-1])
    monkeypatch.setattr(warc, "write", hurt)
    assert 195 <= warc.query(spark, str(tmp_path)).count() < 203
    log = spark.read.json([x for x in logs if "gaps" in x][0])
    assert log.count() >= 1 and log.where("stop <= start").count() == 0


def test_sharded_table(docs, nothing, spark):
    root = new_path(spark, "table")
    t = arrive(docs, root, arrivals=5, target_bytes=1 << 20, base_bytes=1 << 10, fanout=2)
    assert sorted(map(str, t.read().select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sum(r.rows for r in t.manifest().runs) == len(ROWS)
    assert t.read(t.manifest().version - 1).count() <= len(ROWS)
    version = t.manifest().version
    assert t.append(nothing).version == version
    t.append(docs.limit(2).select("doc_id", F.lit(1).alias("new")))
    assert t.read().count() == len(ROWS) + 2 and "new" in t.read().columns
    assert t.manifest().version == version + 1 and t.read(version).count() == len(ROWS)
    other = ShardedTable(spark, root)
    old = other.manifest()
    other._commit(old, old.runs)
    with pytest.raises(RuntimeError):
        t._commit(old, ())
    tiers = [t.tier(r) for r in t.compact().runs]
    assert all(tiers.count(x) < t.fanout for x in tiers)


def test_sharded_table_without_rows(nothing, spark):
    t = arrive(nothing, new_path(spark, "table"), arrivals=3)
    assert t.read().schema == nothing.schema and t.read().collect() == [] and t.manifest().version == 1
    t.append(docs_of(spark, ROWS[:2]))
    assert t.read().count() == 2 and t.read(1).count() == 0
    with pytest.raises(ValueError):
        ShardedTable(spark, new_path(spark, "table")).read()


def test_merged_shards_are_near_the_target(spark):
    big = spark.range(60_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text")
    t = ShardedTable(spark, new_path(spark, "table"), target_bytes=1 << 20, base_bytes=1 << 30, fanout=3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, share in enumerate((1, 2, 7)):
        t.append(big.where(f"doc_id % 10 < {share}").repartition(1 + 9 * k))
    t.compact()
    (run,) = t.manifest().runs
    sizes = [x.getLen() for x in t.fs.listStatus(t._path("runs", run.name)) if x.getPath().getName().startswith("part-")]
    assert run.rows == 60_000 and len(sizes) == run.files >= 4 and max(sizes) < 2 * (1 << 20)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_sharded_writers_meet(spark, monkeypatch):
    """A commit that comes second looks again; a merge whose runs are gone leaves no run behind."""
    t = ShardedTable(spark, new_path(spark, "table"), base_bytes=1, fanout=100)
    t.append(docs_of(spark, ROWS[:3]))
    real, turns = t.manifest, []
    late = lambda v=None: real(v) if v is not None or turns or turns.append(1) else real(real().version - 1)
    t.append(docs_of(spark, ROWS[3:5]))
    monkeypatch.setattr(t, "manifest", late)
    t.append(docs_of(spark, ROWS[5:6]))
    assert t.read().count() == 6 and t.manifest().version == 3
    before = t.manifest()
    run = t._write(t._read(before.runs).coalesce(1), 6)
    assert t._publish(lambda m: None, run) is None and t.manifest() == before
    assert {s.getPath().getName() for s in t.fs.listStatus(t._path("runs"))} == {r.name for r in before.runs}
    t.vacuum(keep=1)
    assert t.read(2).count() == 5
    t.vacuum(keep=1, grace_s=-5)
    assert t.read().count() == 6
