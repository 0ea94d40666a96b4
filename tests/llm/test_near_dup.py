import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import near_dup
from sieveline.llm.near_dup import components, drop_near_duplicates, near_duplicates


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n_bases=12, copies=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, passage = [], rng.choices(vocab, k=40)
    for b in range(n_bases):
        base = rng.choices(vocab, k=rng.choice([3, 8, 60, 200]))
        if b % 3 == 0:
            base = passage + base
        for c in range(copies if b else 4 * copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), (" " if c % 2 else "\n").join(w).upper() if c % 5 == 0 else " ".join(w)))
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def result(df):
    rows = df.collect()
    for r in rows:
        assert r.kept == (None if r.doc_id is None or r.component_id is None else r.doc_id == r.component_id)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize(("small", "levels"), [(400, 12), (20, 12), (5, 2)])
def test_against_brute_force(documents, monkeypatch, small, levels):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    monkeypatch.setattr(near_dup, "OUTSIDERS", 8 if small < 400 else 500)
    monkeypatch.setattr(near_dup, "RUN_SHINGLES", 3000 if small < 400 else 1_000_000)
    monkeypatch.setattr(near_dup, "CROSS", 4_000_000 if small == 20 else 50)
    rows = corpus(small % 50)
    assert result(near_duplicates(documents(rows))) == brute(rows)


def test_awkward_rows(awkward, documents):
    odd = awkward.withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(-1))
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert result(near_duplicates(odd)) == brute(rows)
    both_null = documents([(None, "a b c d e f"), (None, "a b c d e f"), (3, "x\x1cy\u00a0z A")])
    assert result(near_duplicates(both_null)) == brute([(None, "a b c d e f"), (None, "a b c d e f"), (3, "x\x1cy\u00a0z A")])
    assert near_duplicates(documents([])).count() == 0


def test_drop_keeps_one_of_each_group_and_all_columns(documents):
    rows = corpus(7, 5, 10)
    df = documents(rows + [(None, "no id"), (9000, None), (9001, ""), (9002, "solo"), (9002, "solo")]).withColumn("kept", F.lit("x"))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, _, c in brute(rows)} | {9000, 9001, 9002})
    assert kept.where("doc_id is null").count() == 1


def test_drop_judges_rows_and_not_ids(documents):
    t, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t), (2, t), (2, other), (2, other), (None, t), (None, other + " c"), (None, "alone x"), (None, "alone x"), (None, None), (None, None), (3, None)]
    df = documents(rows, {"row": F.lit(1), "id": F.lit("x"), "hash": F.lit(2), "least": F.lit(3), "a b": F.lit(4)})
    got = drop_near_duplicates(df, 80)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, t), (2, other), (None, "alone x"), (None, None), (3, None)], key=str)
    assert drop_near_duplicates(documents([])).count() == 0


def test_recall_of_planted_pairs_at_the_threshold(documents):
    rng = random.Random(3)
    rows, pairs = [], []
    for k in range(150):
        base = [f"p{k}x{i}" for i in range(rng.choice([40, 120, 400]))]
        while True:  # change single words until one more would break the link
            changed = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // 62)):
                changed[at] = f"q{k}x{at}"
            a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, changed))
            if 100 * len(a & b) >= 85 * len(a | b):
                break
            base = [*base, f"p{k}x{len(base)}"]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed))]
    by_id = {d: c for d, _, c in result(near_duplicates(documents(rows)))}
    assert sum(by_id[b] == a for a, b in pairs) == len(pairs)


def test_linked_is_exact_over_all_pairs_of_a_cluster(monkeypatch):
    monkeypatch.setattr(near_dup, "COLUMNS", 64)
    rng = np.random.default_rng(5)
    for _ in range(40):
        pool = rng.integers(0, 2**63, 120, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(60, 119), replace=False)) for _ in range(rng.integers(2, 12))]
        label = near_dup.linked(sets, 60)
        want = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= 60 * (len(a) + len(b) - both):
                        want[i] = want[j] = min(want[i], want[j])
        assert label.tolist() == want


@pytest.mark.parametrize("task_links", [500_000, 40])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, task_links):
    monkeypatch.setattr(near_dup, "TASK_LINKS", task_links)
    key = lambda i: int(i).to_bytes(4, "big")
    links = [(key(i), key(i + 1)) for i in range(60)] + [(key(1000), key(1000 + i)) for i in range(1, 200)]
    got = {bytes(r.key): bytes(r.root) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {key(i): key(0) for i in range(61)} | {key(1000 + i): key(1000) for i in range(200)}


def test_minwise_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[100:], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dup.minwise(a) == near_dup.minwise(b)).mean() - true) < 0.15
