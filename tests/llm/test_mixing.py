import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm.mixing import DIMENSIONS, mix_weights, natural_targets, probabilities, rake, sample_copies, sample_mix, topic_of


def cells_df(spark, table):
    return spark.createDataFrame([(*k, v) for k, v in table.items()], "source string, lang string, topic string, tokens long")


def plain_rake(table, targets, cycles=200):
    keys = list(table)
    w = np.array([table[k] for k in keys], float)
    w /= w.sum()
    for _ in range(cycles):
        for d, t in enumerate(targets):
            for v in {k[d] for k in keys}:
                on = np.array([k[d] == v for k in keys])
                if v in t and w[on].sum() > 0:
                    w[on] *= t[v] / w[on].sum()
    return dict(zip(keys, w / w.sum(), strict=True))


def test_rake_matches_plain_ipf(spark):
    rng = np.random.default_rng(4)
    table = {k: int(rng.integers(1, 5000)) for k in itertools.product(["a", "b", "c"], ["en", "de"], ["prose", "note"])}
    targets = [{"a": 0.2, "b": 0.3, "c": 0.5}, {"en": 0.6, "de": 0.4}, {"prose": 0.9, "note": 0.1}]
    frames = {d: spark.createDataFrame(list(t.items()), "value string, target double") for d, t in zip(DIMENSIONS, targets, strict=True)}
    got = {(r.source, r.lang, r.topic): r.weight for r in rake(cells_df(spark, table), frames, tolerance=1e-9).collect()}
    want = plain_rake(table, targets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_targets_that_no_weights_meet_are_warned_of(spark):
    table = {("a", "en", "prose"): 10, ("b", "de", "prose"): 10}
    frames = {d: spark.createDataFrame(list(t.items()), "value string, target double") for d, t in zip(DIMENSIONS, [{"a": 0.2, "b": 0.8}, {"en": 0.6, "de": 0.4}, {"prose": 1.0}], strict=True)}
    with pytest.warns(UserWarning, match="no weights meet all targets"):
        rake(cells_df(spark, table), frames)


def test_probabilities_meet_the_budget(spark):
    table = {(s, "en", "prose"): t for s, t in [("a", 100), ("b", 1000), ("c", 9000)]}
    rows = probabilities(cells_df(spark, table).withColumn("weight", F.expr("case source when 'a' then 0.3 when 'b' then 0.3 else 0.4 end")), 0.5).collect()
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(0.5 * 10100)
    assert all(0 <= r.probability <= 1 for r in rows) and {r.source for r in rows if r.probability == 1} == {"a", "b"}


def test_weights_and_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix_weights(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.9 * total, rel=1e-3)
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), docs.orderBy("doc_id").collect(), strict=True):
        assert r.n_tokens == len(t.text.split())
    kept = sample_mix(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_rates_follow_targets(spark, documents):
    df = documents([(i, "word " * 200, "en" if i % 4 else "de", "s") for i in range(400)])
    want = {"source": [("s", 1.0)], "lang": [("en", 0.5), ("de", 0.5)], "topic": [("prose", 1.0)]}
    frames = {d: spark.createDataFrame(v, "value string, target double") for d, v in want.items()}
    rows = mix_weights(df, frames, budget=0.4).collect()
    rate = {r.lang: r.rate for r in rows}
    assert rate["de"] / rate["en"] == pytest.approx(3, rel=1e-3)
    share = sum(r.kept for r in rows) / len(rows)
    assert 0.3 < share < 0.5


def test_topics_and_awkward_rows(spark, documents, awkward):
    texts = [("", "empty"), ("a | b | c", "table"), ("a\nb\nc\nd", "listing"), ("a few words here " * 3, "note"), ("word " * 300, "prose")]
    df = documents([(i, t) for i, (t, _) in enumerate(texts)])
    got = {r.doc_id: r.topic for r in mix_weights(df).collect()}
    assert got == {i: x for i, (_, x) in enumerate(texts)}
    odd = awkward.withColumn("topic", F.lit(5)).withColumn("_u", F.lit("clash")).withColumn("weight", F.lit(1))
    rows = mix_weights(odd).collect()
    assert len(rows) == awkward.count() and {(r.source, r.lang) for r in rows} == {("(none)", "(none)")}
    for clash in ("_u", "_rate", "_source", "rate", "row", "u", "copies", "probability", "n_tokens"):
        odd = odd.withColumn(clash, F.lit("clash"))
    for out in (sample_mix(odd), sample_copies(odd)):
        assert out.columns == odd.columns and {tuple(r[c] for c in odd.columns[5:]) for r in out.collect()} <= {tuple(r[c] for c in odd.columns[5:]) for r in odd.collect()}
    assert mix_weights(documents([])).count() == 0
    assert natural_targets(spark.createDataFrame([], "source string, lang string, topic string, tokens long"))["lang"].count() == 0
