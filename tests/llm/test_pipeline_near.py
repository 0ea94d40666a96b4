import corpus_pipeline
from tests.llm.test_near_dup import brute


def test_stage_links_from_a_similarity_of_80_percent(spark, documents):
    words = [f"w{i}" for i in range(104)]
    near = words[:-9] + [f"x{i}" for i in range(9)]  # 91 of 109 shingles shared: 0.835
    below = [f"y{i}" for i in range(13)] + words[13:]  # 87 of 113: 0.77 to the first
    rows = [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(below)), (3, "alone in here")]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect())
    assert got == sorted({c for _, _, c in brute(rows, 80)}) == [0, 2, 3]
    assert len({c for _, _, c in brute(rows, 85)}) == 4


def test_stage_against_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == sorted({c for _, _, c in brute(rows, 80)})
    assert len(got) < len({c for _, _, c in brute(rows)})
