import pytest

from sieveline.llm.language_id import fit, predict, reject_unknown

EN = "the cat sat on the mat and the dog ran to the house"
DE = "der hund und die katze sind in dem haus und der garten"
RU = "кошка сидела на коврике и собака побежала домой"
ZH = "猫坐在垫子上 狗跑回家"


@pytest.mark.parametrize("majority", [0.5, 0.6, 0.95])
def test_unlearned_scripts_go_whatever_the_mix(documents, majority):
    n_en = int(100 * majority)
    model = fit(documents([(i, EN if i < n_en else DE, "en" if i < n_en else "de", "s") for i in range(100)]))
    docs = documents([(1, EN), (2, DE), (3, RU), (4, ZH), (5, " ".join([RU] * 500)), (6, f"{EN} {RU} {RU} {RU}"), (7, f"{EN} собака"), (8, None), (9, "12 34"), (10, "the house of katze")])
    assert {r.doc_id for r in reject_unknown(docs, model).collect()} == {1, 2, 7, 10}
    if majority > 0.5:
        assert {r.score > 0.5 for r in predict(docs, model).where("doc_id = 3").collect()} == {True}


def test_texts_of_learned_languages_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = docs.where("text rlike '\\\\p{L}'")
    kept = reject_unknown(docs, fit(docs)).count()
    assert letters.count() - 2 <= kept <= letters.count()


def test_columns_stay(documents):
    docs = documents([(1, EN, "en", "s")])
    out = reject_unknown(docs, fit(docs))
    assert out.columns == docs.columns and out.count() == 1
