from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm.decontaminate import find_leaks
from tests.llm.test_near_dup import brute


def test_stages_keep_their_promises(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d).persist()
        steps[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = steps["language_id"]
    assert before.count() - after.count() <= before.where("not text rlike '\\\\p{L}'").count() + 1
    before, after = steps["near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in before.collect()], 80)})
    before, after = steps["decontamination"]
    leaks = find_leaks(before, spark.read.parquet(f"{d}/benchmark.parquet")).select("doc_id").distinct()
    assert leaks.count() > 0 and after.count() == before.count() - leaks.count()
    before, after = steps["mixing"]
    assert 0.8 * before.count() < after.count() < before.count()
    before, after = steps["sharding"]
    assert after.count() == before.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(r.doc_id for r in after.collect())


def test_stages_take_awkward_tables(spark, documents, awkward):
    d = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(40))
    rows = documents([(20, text, "en", "a"), (20, text, "en", "a"), (None, text + " more", "en", None), (21, "plain other words of another text", None, "a"), (22, "x " * 30_000, "de", "b")])
    docs = awkward.unionByName(rows)
    for name in ("row", "u", "rate", "_rate", "_source", "id", "hash", "kept", "key", "run", "n_tokens", "topic", "a b"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, d)
            got = out.collect()
            if name != "sharding":
                assert out.columns == table.columns, name
                assert all(r[c] == f"own {c}" for r in got for c in table.columns[5:]), name
            assert not got or table is docs, name
        assert corpus_pipeline.near_dedup(spark, table, d).where("text like 'word0%'").count() == (table is docs)


def test_finished_stages_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "scratch_dir", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(p.name for p in tmp_path.glob("pipeline-*/*")) == ["4-sharding"]
