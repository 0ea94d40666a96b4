import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm.mixing import DIMENSIONS, mix_weights, natural_targets, sample_copies

#: Largest difference of an attained marginal share from its target, on the table below.
CLOSE = 0.015


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def rated(docs):
    return mix_weights(docs).persist()


def shares(rows, d, tokens):
    sums = {r[0]: r[1] or 0 for r in rows.groupBy(d).agg(F.sum(tokens)).collect()}
    return {k: v / sum(sums.values()) for k, v in sums.items()}


def targets_of(rated):
    cells = rated.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    return {d: {r.value: r.target for r in t.collect()} for d, t in natural_targets(cells).items()}


def test_copies_attain_the_targets_at_the_production_budget(rated):
    assert rated.where("kept <> (copies > 0)").count() == 0 and rated.where("abs(copies - rate) >= 1 and n_tokens > 0").count() == 0
    for d, want in targets_of(rated).items():
        got = shares(rated, d, F.col("n_tokens") * F.col("copies"))
        assert all(abs(got[k] - want[k]) < CLOSE for k in want), (d, got, want)


def test_stage_attains_the_targets(docs, rated):
    out = corpus_pipeline.mixing(None, docs, "")
    assert out.columns == docs.columns
    # source, language and topic of the copies, by the same columns
    counts = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    both = rated.join(counts, "doc_id").persist()
    for d, want in targets_of(rated).items():
        got = shares(both, d, F.col("n_tokens") * F.col("times"))
        assert all(abs(got.get(k, 0) - want[k]) < CLOSE for k in want), (d, got, want)
    assert both.agg(F.sum("times")).first()[0] == pytest.approx(0.9 * docs.count(), rel=0.02)


def test_given_targets_beyond_the_tokens_there_are(spark, documents):
    df = documents([(i, "word " * 200, "en" if i % 20 else "de", "s") for i in range(400)])
    want = {"source": [("s", 1.0)], "lang": [("en", 0.5), ("de", 0.5)], "topic": [("prose", 1.0)]}
    frames = {d: spark.createDataFrame(v, "value string, target double") for d, v in want.items()}
    out = sample_copies(df, frames)
    assert out.columns == df.columns
    assert out.where("lang = 'de'").count() / out.count() == pytest.approx(0.5, abs=0.03)
    assert sample_copies(documents([])).count() == 0
