import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm.common import id_crc
from sieveline.llm.quality import FEATURES, features, fit, fit_gam, score_documents, training_labels
from sieveline.llm.queries import op4_quality


def test_features_by_hand():
    f = dict(zip(FEATURES, features("Ab cd, AB.\nÄb 12 | aa\nab\nab"), strict=True))
    assert f["log_words"] == math.log(9)
    assert f["bar_share"] == 1 / 9 and f["stop_share"] == 1 / 9 and f["comma_share"] == 1 / 9
    assert f["unique_words"] == 8 / 9 and f["same_lines"] == 1 - 3 / 4
    assert features(None) == features("") == features(" \n\t") == [0.0] * len(FEATURES)


def test_gam_scores_equal_their_tables_and_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit_gam(x, y, rounds=20, pairs=2, pair_rounds=60)
    assert (0, 1) in model.pairs
    p = model.score(x)
    assert ((p > 0.5) == y).mean() > 0.95
    b = model.bins(x)
    for i in range(50):
        z = model.intercept + sum(t[b[i, f]] for f, t in enumerate(model.tables)) + sum(t[b[i, a], b[i, c]] for (a, c), t in model.pairs.items())
        assert p[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_one_class_and_no_rows():
    assert (fit_gam(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))) == 0.5).all()
    assert (fit_gam(np.zeros((50, 3)), np.ones(50)).score(np.zeros((2, 3))) > 0.9).all()


def test_awkward_rows_and_labels(spark, documents, awkward):
    rng = random.Random(1)
    good = [(100 + i, " ".join(rng.choices(["the", "garden", "was", "quiet."], k=80))) for i in range(40)]
    junk = [(200 + i, " ".join(w + "%%%" for w in rng.choices(["the", "garden"], k=80))) for i in range(40)]
    labels = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in junk] + [(5, None), (None, 1), (6, 7), (99999, 1)], "doc_id long, quality int")
    docs = documents(good + junk).union(awkward).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(1))
    rows = score_documents(docs, fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[d].predicted == 1 for d, _ in good) and all(by[d].predicted == 0 for d, _ in junk)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert by[1].score == by[2].score == by[3].score
    assert score_documents(documents([]), fit(documents([]), labels)).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op4_quality(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    held = labels.where(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2).count()
    assert training_labels(labels).count() + held == labels.count()
