import hashlib

from pyspark.sql import functions as F

from sieveline.operators import tokenizer
from sieveline.sources import files


def test_pair_merges_give_the_library_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokenizer.merger(path)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()] + ["", " ", "a  b\n\nc", "naïve café 123 ₹5", "it's x'll\t!?"]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert own.encode(None) == []


def test_files_round_trip_and_digests(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), "id int, t string").collect())) == [(1, "a"), (2, None)]
    folder = tmp_path / "staged"
    folder.mkdir()
    (folder / "x.bin").write_bytes(b"abc")
    (folder / "y.bin").write_bytes(b"changed")
    found = files.file_digests(spark, str(folder))
    assert {r.name: r.sha256 for r in found.collect()}["x.bin"] == hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("x.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("y.bin", 7, "0"), ("z.bin", 1, "0"), ("x.bin", 4, "0")], "name string, bytes long, sha256 string")
    assert sorted(map(tuple, files.verify_files(found, manifest).collect())) == [("x.bin", "size"), ("y.bin", "changed"), ("z.bin", "missing")]


def test_manifests(spark):
    raw = ['{"schema": 2, "modelVersion": "m", "temperatureByBucket": {"noul:2": 2.0}, "temperatures": {"noul:2": 9.0, "default": 1.5}}', '{"schema": 2, "temperatureByBucket": {"a": 1.0}, "reportOnly": true}', "{}", "not json"]
    rows = files.parse_manifest(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [(r.schema, r.calibrated, r.report_only) for r in rows] == [(2, True, False), (2, False, True), (1, False, False), (1, False, False)]
    assert rows[0].by_bucket == {"noul:2": 2.0, "default": 1.5} and rows[2].by_type == [1.0, 1.0, 1.0]


def test_pairs_within_a_few_bits_as_all_pairs(spark):
    import random

    from sieveline.operators.near_pairs import block_masks, pairs_within

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b): r.distance for r in pairs_within(spark.createDataFrame(list(enumerate(signed)), "k long, fp long"), "k", "fp", 3).collect()}
    least = {}
    for k, p in enumerate(prints):
        least.setdefault(p, k)
    first = sorted(least.items(), key=lambda x: x[1])
    want = {(min(i, j), max(i, j)): (p ^ q).bit_count() for p, i in first for q, j in first if i < j and (p ^ q).bit_count() <= 3}
    want |= {(least[p], k): 0 for k, p in enumerate(prints) if least[p] != k}
    assert got == want
    assert len(block_masks(3)) == 20 and len(set(block_masks(3))) == 20
