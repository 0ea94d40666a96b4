import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang, source) rows; extra clashing columns on demand."""

    def make(rows, extra=None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        return df

    return make


AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "a null id here"), (5, "!!! ???"), (6, "same words " * 3000), (7, "café धन \U0001f600 Á")]


@pytest.fixture()
def awkward(documents):
    return documents(AWKWARD)
