"""Known values, and plain versions of what SQL cannot express."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import decode, extract, fingerprint, plausibility, text
from sieveline.operators import dataset, near_pairs, tier0, windows
from sieveline.streaming import windows as streams


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_normalisation(spark):
    r = one(spark, "Gu​arаnteed  ३% рrofit", text.normalize)
    assert r.text == "guaranteed 3% profit" and r.obfuscation >= 3
    assert one(spark, "https://WWW.Example.com/a?utm_source=x&id=7#top", text.canonical_url) == "https://example.com/a?id=7"
    assert one(spark, "see HTTP://Www.A.in/?ref=1&si=2 ok", text.normalize).text == "see http://a.in ok"
    assert one(spark, "ﬁne １２", text.normalize).text == "fine 12"
    assert one(spark, "", text.normalize).text == ""


def test_percent_and_number_labels(spark):
    assert [one(spark, v, text.percent_label, "double") for v in (12.34, 1234567.0, 123456.0, 999.94)] == ["12.3%", "astronomically", "1,23,456%", "999.9%"]
    assert [one(spark, v, text.percent_label, "double") for v in (0.15, 0.25, 0.35, 999.96, 1.25, 2.75)] == ["0.1%", "0.3%", "0.3%", "1000.0%", "1.3%", "2.8%"]
    assert [one(spark, v, text.short_number, "double") for v in (250000.0, 1500.0, 12.0)] == ["2.5L", "1.5k", "12"]


def test_entities(spark):
    assert one(spark, "pay ₹4.2 lakh", extract.money)[0].rupees == pytest.approx(420000)
    assert [r.period for r in one(spark, "5% returns per month", extract.returns)] == ["unknown"]
    assert one(spark, "10% annual", extract.returns) == []
    assert one(spark, "foo.info/x", extract.urls) == ["foo.in"]
    assert [u.known for u in one(spark, "ab@ybl b1@company cc@gmail", extract.upi)] == [True, False]
    assert [p.kind for p in one(spark, "1600123456 / 9812345678 / +44 20 7946 0958", extract.phones)] == ["trai_1600", "mobile", "international"]
    assert one(spark, "reg ina000017001 xina000017001", extract.registrations) == ["INA000017001"]


def test_plausibility(spark):
    assert one(spark, 1.0, lambda c: plausibility.annualise(c, F.lit("month")), "double") == pytest.approx(12.682503)
    assert one(spark, 3.0, lambda c: plausibility.annualise(c, F.lit("day")), "double") <= 1e9
    assert one(spark, 7.2, plausibility.doubling_years, "double") == pytest.approx(9.97, abs=0.01)
    assert one(spark, 10.0, lambda c: plausibility.recruitment(c, F.lit(100), 2), "double") == [10, 11]


def test_fingerprints(spark):
    assert one(spark, "abc", fingerprint.sha256_hex) == hashlib.sha256(b"abc").hexdigest()
    h = 0xCBF29CE484222325
    for c in "hello wörld":
        h = (h ^ ord(c)) * 0x100000001B3 % 2**64
    assert one(spark, "hello wörld", fingerprint.fnv1a64_hex) == f"{h:016x}"
    g = 0x811C9DC5
    for c in "caller":
        g = (g ^ ord(c)) * 16777619 % 2**32
    assert one(spark, "caller", fingerprint.fnv1a32) == g
    a = "guaranteed 3% daily profit join our vip group today limited seats"
    rows = spark.createDataFrame([(a,), (a + " now",), ("completely different words about a garden party",), ("abc",)], "x string").select(fingerprint.simhash64(F.col("x")).alias("s")).collect()
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(rows[0].s, rows[1].s) <= 6 < bits(rows[0].s, rows[2].s) and rows[3].s == 0


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for v in values] + [values[0]] * 3
    signed = [v - 2**64 if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "k int, fp bigint")
    got = {(r.a, r.b): r.distance for r in near_pairs.pairs_within(rows, "k", "fp", 3).collect()}
    least = {v: min(i for i, w in enumerate(values) if w == v) for v in values}
    for i, v in enumerate(values):
        for j, w in enumerate(values[:i]):
            n = bin(v ^ w).count("1")
            if n <= 3:
                a, b = sorted((least[v], least[w])) if v != w else (least[v], i)
                assert got.get((a, b)) == n
    assert all(d <= 3 for d in got.values())


def test_verdicts(spark):
    scam = "Guaranteed 3% daily profit! Join our VIP group, pay ₹50,000 to x@ybl today only. Withdrawal fee applies"
    rows = spark.createDataFrame([(scam,), ("SEBI warns investors: beware of unregistered tips",), (None,)], "text string")
    got = [r.rung for r in tier0.tier0(rows).collect()]
    assert got[0] == "known_scam" and got[1] in ("safe_pattern", "unclear") and got[2] == "safe_pattern"


def test_decode(spark):
    p = spark.sql("select array(0.1d, 0.2d, 0.7d) p, array(2, 0, 1) o").select(decode.unpermute(F.col("p"), F.col("o")).alias("y")).first().y
    assert p == pytest.approx([0.2, 0.7, 0.1])
    t = spark.sql("select map('choice:3-5', 2.5d, 'default', 1.5d) m, array(5.0d, 1.0d, 1.0d) a").select(
        decode.temperature_for(F.col("m"), F.col("a"), F.lit("choice"), F.lit(4)).alias("x"), decode.temperature_for(F.col("m"), F.col("a"), F.lit("choice"), F.lit(2)).alias("y"), decode.temperature_for(F.expr("map('z', 1.0d)"), F.col("a"), F.lit("choice"), F.lit(2)).alias("z")
    ).first()
    assert (t.x, t.y, t.z) == (2.5, 1.5, 5.0)


def test_windows_cover_the_text():
    rng = random.Random(2)
    body = " ".join("word" * rng.randint(1, 3) + rng.choice(["", ".", "!"]) for _ in range(900))
    for source in (body, "\n\n".join(body[i : i + 300] for i in range(0, 3000, 300)), "x" * 5000, "Agent: hi\n" * 300):
        strategy, found, left_out = windows.segment(source, 900, 120, 100)
        assert left_out == 0 and found[0][0] == 0 and found[-1][1] == len(source)
        assert all(b[0] <= a[1] for a, b in zip(found, found[1:], strict=False))
        assert all(stop > start for start, stop, _ in found)
    assert windows.segment("short")[0] == "single" and windows.segment("  ")[1] == [] and windows.segment(None)[1] == []
    assert windows.segment("x" * 9000, most=4)[2] > 0 and len(windows.segment("x" * 9000, most=4)[1]) == 4


def test_split_rule(spark):
    got = one(spark, "claim-01", dataset.split_bucket)
    assert got == int(hashlib.sha256(b"claim-01").hexdigest()[:8], 16) % 100


def test_streams_give_the_batch_results(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), 10)
    query = streams.tumbling(stream, "6 hours", "400 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbling")) == key(streams.tumbling(events, "6 hours"))


def test_upsert_stream(spark, tmp_path):
    writes = spark.sql("select 'a' hash, 'caution' rung, timestamp'2026-01-01' ts union all select 'a', 'unclear', timestamp'2026-01-02' union all select 'b', 'caution', timestamp'2026-01-01'")
    writes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(writes.schema).parquet(str(tmp_path / "in"))
    query = streams.upsert_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.hash: (r.rung, r.hits) for r in streams.read_verdicts(spark, str(tmp_path / "out"), 0).collect()}
    assert got == {"a": ("unclear", 2), "b": ("caution", 1)}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    rng, out = random.Random(3), str(tmp_path / "out")
    schema = "hash string, rung string, ts timestamp"
    batches = [[(f"h{rng.randrange(40)}", rng.choice(["caution", "unclear"]), datetime.datetime(2026, 1, 1 + k, i)) for i in range(6)] for k in range(5)]
    batches[3].append((None, "caution", datetime.datetime(2026, 1, 4)))
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        query = streams.upsert_sink(stream, out, str(tmp_path / "ck"), 16).trigger(availableNow=True).start()
        query.awaitTermination()
    want = {}
    for h, r, t in sorted((x for b in batches for x in b), key=lambda x: (x[2], x[1])):
        want[h] = (r, want.get(h, ("", 0))[1] + 1, t)
    assert {r.hash: (r.rung, r.hits, r.updated_at) for r in streams.read_verdicts(spark, out, 4).collect()} == want
    written = {p.parent.name: {c.name for c in p.parent.glob("bucket=*")} for p in (tmp_path / "out" / "data").glob("v=*/bucket=*")}
    assert all(len(names) < 16 for names in written.values())
    assert sorted(p.name for p in (tmp_path / "out" / "manifest").iterdir()) == ["v=3", "v=4"]
    held = {(b, v) for e in (3, 4) for b, v in streams._versions(spark, out, e).items()}
    assert {(int(c[7:]), int(v[2:])) for v, names in written.items() for c in names} == held
