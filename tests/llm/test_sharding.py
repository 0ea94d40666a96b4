import hashlib
import zlib

from pyspark.sql import functions as F

from sieveline.llm.sharding import jump_shard, shard_documents


def brute(key, shards):
    b, j, i = -1, 0, 1
    while j < shards:
        b = j
        r = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        j, i = int((b + 1) // r) if (b + 1) / r == (b + 1) // r else int((b + 1) / r), i + 1
    return b


def test_matches_plain_jump_hash_and_moves_only_into_the_new_shard(spark):
    df = spark.range(3000).select(F.col("id"), *[jump_shard(F.col("id").cast("string"), n).alias(f"s{n}") for n in (1, 7, 8, 9)])
    rows = df.collect()
    for r in rows:
        assert [r.s1, r.s7, r.s8, r.s9] == [brute(str(r.id), n) for n in (1, 7, 8, 9)]
        assert r.s9 in (r.s8, 8)
    moved = sum(r.s9 != r.s8 for r in rows)
    assert 230 < moved < 440


def test_slots_sizes_and_awkward_rows(awkward):
    clash = awkward.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(7)).withColumn("law", F.lit(None).cast("string"))
    rows = shard_documents(clash, 8, parts=4).collect()
    source = [(r.doc_id, r.text or "") for r in awkward.collect()]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in source)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows if r.doc_id == 4} == {brute("4", 8)}
    assert {r.shard for r in rows if r.doc_id is None} == {brute("null", 8)}
    assert all(r.law == "key" for r in rows)


def test_empty_table(documents):
    assert shard_documents(documents([]), 8).count() == 0
