"""The pipeline's stages, each against a plain computation on its own input."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from landmesh.llm import cotraining, mixing, tokens
from landmesh.llm.store import materialize

from .test_edges import docs_of, naive_components, naive_cut, split, words

DIR = "/root/testdata/sf0.001"


def row_of(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def test_stage_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "best-fit packing"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("n_words", F.lit("mine"))
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = materialize(P.quality(spark, docs, DIR), "t")
    assert good.columns == docs.columns
    kept = {r.doc_id for r in cotraining.classify(docs, labels).where("kept").collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(kept)

    one = materialize(P.near_duplicates(spark, good, DIR), "t")
    rows = [row_of(r) for r in good.collect()]
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in naive_components(rows).values()})

    cut = materialize(P.repeats(spark, one, DIR), "t")
    want = naive_cut([row_of(r) for r in one.collect()], 20)
    assert cut.columns == docs.columns
    assert {r.doc_id: " ".join(split(r.text)) for r in cut.collect()} == {i: v[0][2] for i, v in want.items()}
    before = {r.doc_id: r.text for r in one.collect()}
    assert all(r.text == before[r.doc_id] for r in cut.collect() if not want[r.doc_id][0][1])
    assert cut.where("n_chars <> length(text) OR n_words <> 'mine' OR size <> 'clash'").count() == 0

    mixed = materialize(P.mixture(spark, cut, DIR), "t")
    copies = {r.doc_id: r.copies for r in mixing.mix(cut).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: k for i, k in copies.items() if k})

    pieces = P.packed(spark, mixed, DIR).collect()
    enc = tokens.encoder("byte_bpe_50k")
    assert sum(r.length for r in pieces) == sum(len(enc.encode(r.text)) + 1 for r in mixed.collect())
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_repeated_rows_and_nulls_pass_through(spark):
    df = docs_of(spark, [(1, words(100, 1), "en", "a", 1), (1, words(100, 1), "en", "a", 1), (2, words(100, 1), "en", "a", 1), (None, None, None, None, None), (3, "", None, None, 0)])
    one = P.near_duplicates(spark, df, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert P.repeats(spark, one, "").count() == 3
    assert {r.doc_id for r in P.packed(spark, P.mixture(spark, df, ""), "").collect()} <= {1, 2, 3, None}


def test_empty_table_passes_through(spark):
    df = docs_of(spark, [], extra=True)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = cotraining.keep_good(df, labels)
    for _, stage in P.STAGES[1:-1]:
        docs = materialize(stage(spark, docs, ""), "t")
        assert docs.columns == df.columns and docs.count() == 0
    assert P.packed(spark, docs, "").collect() == []
