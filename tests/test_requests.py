import random

from pyspark.sql import functions as F

from sieveline.functions import fingerprint
from sieveline.operators import dataset, records
from sieveline.sources import requests


def fnv(units, offset, prime, mask):
    h = offset
    for u in units:
        h = ((h ^ u) * prime) & mask
    return h


def test_hashes_take_utf16_units(spark):
    texts = ["", "plain", "ünï", "a\U0001f600b", "\U0001f600\U00010000", "中文"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint.fnv1a64_hex(F.col("t")).alias("h"), fingerprint.fnv1a32(F.col("t")).alias("s"))
    for r in df.collect():
        raw = r.t.encode("utf-16-le")
        units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
        assert r.h == f"{fnv(units, 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1):016x}"
        assert r.s == fnv(units, 0x811C9DC5, 0x01000193, 2**32 - 1)


def test_stream_cut_anywhere_gives_the_same_tokens(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for key in range(30):
        lines = []
        for i in range(rng.randrange(8)):
            kind = rng.randrange(5)
            if kind == 0:
                lines.append(": comment")
            elif kind == 1:
                lines.append("data: [DONE]")
            elif kind == 2:
                lines.append('data: {"broken":')
            else:
                want.setdefault(key, []).append(f"t{key}-{i}")
                lines.append(f'data: {{"choices":[{{"delta":{{"content":"t{key}-{i}"}}}}]}}')
        text = "".join(x + "\n" for x in lines) + 'data: {"choices":[{"delta":{"content":"open"}}]}' * (key % 2)
        at = 0
        while at < len(text):
            step = rng.choice([1, 3, 20, 90])
            rows.append((key, len(rows), text[at : at + step]))
            at += step
    out = requests.stream_tokens(spark.createDataFrame(rows, "key int, seq int, chunk string"), "key").orderBy("key", "seq", "i").collect()
    got = {}
    for r in out:
        got.setdefault(r.key, []).append(r.token)
    assert got == want


def test_bodies_that_cannot_be_read_give_no_fields(spark):
    df = spark.createDataFrame([("application/json", "{oops"), ("application/json", None), ("x-form", "&&a=1&a=2&=&b"), (None, None)], "c string, b string")
    got = [r[0] for r in df.select(requests.read_inputs(F.col("c"), F.col("b"))).collect()]
    assert got == [{}, {}, {"a": "2", "": "", "b": ""}, {"text": ""}]


def test_obfuscation_hides_one_character_and_swaps_one_letter(spark):
    df = spark.createDataFrame([("pay now", 0.5), ("xyz", 0.0), ("123", 0.99), ("", 0.1)], "t string, u double")
    got = [r[0] for r in df.select(dataset.obfuscate(F.col("t"), F.col("u"))).collect()]
    assert got == ["pаy\u200b now", "\u200bхyz", "12\u200b3", ""]


def test_series_of_the_last_days(spark):
    rows = records.network_series(spark, 7).orderBy("day").collect()
    assert len(rows) == 7 and str(rows[-1].day) == "2026-10-03"
    assert all(0 < r.scams < r.checks and r.cache_hits <= r.checks and r.tier1 >= 0 for r in rows)
