import random

from pyspark.sql import functions as F

from sieveline.llm import decontaminate
from sieveline.llm.decontaminate import find_leaks, remove_leaks

import regex


def brute(docs, items, t=0.8):
    words = lambda x: regex.findall(r"[\p{L}\p{N}]+", (x or "").lower())
    out = []
    for i, text in items:
        w = words(text)
        n = min(len(w), 5)
        if not n:
            continue
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, body in docs:
            v = words(body)
            found = len(s & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)})
            if found >= t * len(s) - 1e-9:
                out.append((d, i, len(s), found))
    return sorted(out, key=str)


def items_df(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, documents, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 30, 80])))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, "dup item text of six words"), (94, "dup item text of six words")]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.choice([3, 50, 400]))
        if i % 2:
            planted = (items[i % 40][1] or "").split()
            for _ in range(i % 4):
                planted[rng.randrange(len(planted))] = "CHANGED"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "!!" for x in planted]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "Dup item-text, of SIX words"), (102, "Dup item-text, of SIX words"), (None, "dup item text of six words")]
    want = brute(docs, items)
    assert len(want) > 20
    df = documents(docs).withColumn("item_id", F.lit(5)).withColumn("n_found", F.lit("clash"))
    for block in (10**9, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in find_leaks(df, items_df(spark, items)).collect()), key=str)
        assert got == want
        kept = remove_leaks(df, items_df(spark, items))
        assert kept.columns == df.columns
        leaky = {d for d, *_ in want}
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in leaky)


def test_empty_tables(spark, documents):
    assert find_leaks(documents([]), items_df(spark, [(1, "a b c d e f")])).count() == 0
    assert find_leaks(documents([(1, "a b c d e f")]), items_df(spark, [])).count() == 0
    assert remove_leaks(documents([(1, "a b c d e f")]), items_df(spark, [])).count() == 1


def test_size_classes_meet_every_pair_at_the_bound():
    rng = random.Random(1)
    for m in (6, 14, 40, 100):
        words = [f"x{rng.random()}" for _ in range(m)]
        items = decontaminate.index_items([(1, " ".join(words))])
        for cut in (0, m // 5):
            table = decontaminate.ChunkTable(decontaminate._chunk_words)
            w, s = table.values([words[cut:]])
            n = m - 4
            found = decontaminate.matches(items, w, s)
            assert bool(found) == (n - cut >= 0.8 * n)


def test_partitions_have_their_own_sketch_and_threshold():
    rng = random.Random(2)
    texts = [" ".join(f"y{rng.randrange(10**12)}" for _ in range(m)) for m in (3, 6, 7, 12, 20, 36, 70, 500) for _ in range(3)]
    items = decontaminate.index_items(list(enumerate(texts)))
    assert set(items.partitions) == {(3, 1), (5, 2), (5, 4), (5, 5), (5, 6), (5, 7), (5, 9)}
    sketches = {size: p.sketch for (n, size), p in items.partitions.items() if n == 5}
    assert sketches[2] < sketches[5] < sketches[7] < sketches[9] == decontaminate.SKETCH
    for (_, size), p in items.partitions.items():
        for i in set(p.members.tolist()):
            assert min(p.sketch, len(items.sets[i])) - decontaminate._lacking(len(items.sets[i]), 0.8) >= p.need or p.sketch == decontaminate.SKETCH
    # one partition's shingles are not looked up in another's
    alone = items.partitions[5, 5]
    other = items.sets[texts.index(next(t for t in texts if len(t.split()) == 6))]
    assert alone.candidates(other, decontaminate.np.zeros(len(other), int))[0].size == 0
