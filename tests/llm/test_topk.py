import math
import random

import numpy as np
import pytest

from sieveline.llm import topk
from sieveline.llm.topk import build, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in ok:
        if i % every == 0:
            raw = [list(map(np.float32, w)) for j, w, *_ in rows if j == i and w is not None and None not in w]
            asks[i] = [math.floor(64 * float(x)) for x in min(raw)]
    out = []
    for q, v in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [8192, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "DATA_BLOCK", 100)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], 1) for i in range(400)]
    rows += [(1000 + i, centres[0], 1) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2040, [float("nan")] * 6, 1), (2060, [float("inf")] * 6, 1), (None, centres[1], 1), (2080, [1.0, -1.0], 1), (2100, [], 1), (7, centres[2], 1), (7, centres[2], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(top_k(df, 5, 20, block)) == brute(rows, 5, 20)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [0.5, 0.5], 1), (3, [0.5, 0.5], 1)]
    assert got(top_k(spark.createDataFrame(rows, SCHEMA), 20, 20)) == brute(rows, 20, 20)
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0


def test_cover_tree_covers_and_separates(monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    x = np.random.default_rng(1).normal(size=(300, 3))

    def walk(node):
        assert np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            centres = np.array([c.centre for c in node.children])
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert gaps[~np.eye(len(centres), dtype=bool)].min() > node.radius / topk.SHRINK - 1e-9
        return 1 + sum(map(walk, node.children))

    assert walk(build(x)) > 10


def searched(x, ids, every, start=400):
    queries = np.flatnonzero(ids % every == 0)
    first = topk.Search(ids[queries], x[queries], 20)
    first.add(ids[:start], x[:start])
    search = topk.Search(ids[queries], x[queries], 20, first.kth(np.arange(len(queries))))
    search.add(ids, x)
    return search.compared / (len(queries) * len(x))


def test_balls_prune_node_pairs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64)) * 40
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 64)) * 3)
    assert searched(x, np.arange(8000), 20) < 0.15


def test_vectors_of_the_tables(spark):
    """Random directions: nearly nothing can be pruned, whatever the tree; a group of near copies can."""
    shares = {}
    for t in ("sf0.1", "check_h"):
        rows = spark.read.parquet(f"/root/testdata/{t}/embeddings.parquet").toPandas()
        x = np.floor(64 * np.stack(rows.embedding.to_list()).astype(float))
        shares[t] = searched(x, rows.vec_id.to_numpy(), 20)
    print(shares)
    assert shares["sf0.1"] <= 1 and shares["check_h"] < 0.97
