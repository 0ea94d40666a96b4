import numpy as np
from pyspark.sql import functions as F

from sieveline.llm.language_id import allotted, fit, fit_counts, gram_windows, predict, reject_unknown, training_rows, words_of
from sieveline.llm.queries import op10_language_id

EN = "the cat sat on the mat and the dog ran to the house"
DE = "der hund und die katze sind in dem haus und der garten"


def plain_scores(model, text):
    total = model.priors.copy()
    for w in words_of(text):
        total = total + model.word_score(w)
    p = np.exp(total - total.max())
    return p / p.sum()


def test_known_words_then_shorter_grams():
    model = fit_counts([("en", "house", 5), ("de", "haus", 5), ("de", "garten", 2)], {"en": 5, "de": 5})
    en = model.langs.index("en")
    assert model.word_score("house").argmax() == en
    assert model.word_score("houses").argmax() == en  # five-grams of the known word
    assert model.word_score("gartens").argmax() != en
    assert (model.word_score("हिन") == 0).all()


def test_matches_plain_scoring_and_awkward_rows(spark, documents, awkward):
    train = documents([(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(20)] + [(30, None, "en", "s"), (31, "xx", None, "s")])
    model = fit(train)
    docs = awkward.union(documents([(50, EN), (51, DE), (52, "katzen und hunde")])).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    rows = predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if words_of(r.text or ""):
            p = plain_scores(model, r.text)
            assert r.lang_pred == model.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-9
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = reject_unknown(awkward, model)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} <= {4, 6, 7, None}


def test_empty_training_and_empty_table(documents):
    model = fit(documents([]))
    assert [r.lang_pred for r in predict(documents([(1, "word")]), model).collect()] == ["und"]
    assert predict(documents([]), model).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert training_rows(spark.read.parquet(f"{d}/documents.parquet")).count() + len(rows) == 1000


def test_spark_and_plain_fit_agree_and_nothing_is_cut(documents):
    rows = [(i, f"{EN} word{i}qx", "en", "s") if i % 3 else (i, f"{DE} wort{i}zy", "de", "s") for i in range(300)]
    model = fit(documents(rows))
    plain = fit_counts([(x, w, 1) for _, t, x, _ in rows for w in words_of(t)], {"en": 200, "de": 100})
    assert model.langs == plain.langs and np.allclose(model.priors, plain.priors) and model.tables.keys() == plain.tables.keys()
    for size, table in model.tables.items():
        assert (table.hashes == plain.tables[size].hashes).all() and np.allclose(table.logs, plain.tables[size].logs)
    assert len(model.tables[0].hashes) == len({w for _, t, _, _ in rows for w in words_of(t)})


def test_grams_are_those_of_padded_words():
    words = ["a", "bc", "wort", "é"]
    for n in (1, 2, 3, 4, 5):
        _, word = gram_windows(words, n)
        want = [k for k, w in enumerate(words) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " "]
        assert word.tolist() == want
    assert gram_windows(["abab"], 2)[0][1] == gram_windows(["xab"], 2)[0][2]


def test_sample_takes_evenly_from_the_languages():
    share = allotted({"en": 10_000, "de": 3000, "fr": 100}, 1200)
    assert share["fr"] == 1 and abs(share["de"] * 3000 - 550) < 1e-9 and abs(share["en"] * 10_000 - 550) < 1e-9
    assert allotted({"en": 5}, 10) == {"en": 1}


def test_equal_texts_get_equal_scores(documents):
    model = fit(documents([(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(20)]))
    rows = predict(documents([(i, t) for i, t in enumerate([EN, "die katze sat", EN + " " + DE, "die katze sat", DE * 50, "die katze sat"])]).coalesce(1), model).collect()
    assert len({r.score for r in rows if r.text == "die katze sat"}) == 1
