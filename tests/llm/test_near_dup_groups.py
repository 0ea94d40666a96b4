"""Large groups: what is joined by node grows with the rows, not with the square of a group."""

import random

import pytest

import corpus_pipeline
from sieveline.llm import near_dup
from sieveline.llm.near_dup import near_duplicates
from tests.llm.test_near_dup import brute, result


def groups(size):
    """A group of near copies and half as many other texts that begin as they do, so that nodes hold both."""
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(3000)]
    line, base = rng.choices(vocab, k=60), rng.choices(vocab, k=100)
    near, loose = [], []
    for _ in range(size):
        w = line + base
        w[rng.randrange(60, len(w))] = rng.choice(vocab)
        near.append(" ".join(w))
    for _ in range(size // 2):
        loose.append(" ".join(line + rng.choices(vocab, k=60)))
    texts = near + loose
    rng.shuffle(texts)
    return list(enumerate(texts))


def joined_by_node(spark, run):
    """The rows that the joins on node give while run() runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions, total = store.executionsList(), 0
    for i in range(before, executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" in node.name() and "[node#" in node.desc():
                for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, out


@pytest.fixture()
def small_nodes(monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 20)
    monkeypatch.setattr(near_dup, "OUTSIDERS", 50)
    monkeypatch.setattr(near_dup, "CROSS", 10_000)


def test_joins_by_node_grow_with_the_rows(spark, documents, small_nodes):
    joined = {}
    for size in (80, 160):
        rows = groups(size)
        joined[size], got = joined_by_node(spark, lambda rows=rows: result(near_duplicates(documents(rows))))
        assert got == brute(rows)
        assert 0 < joined[size] <= 2 * near_dup.TREES * near_dup.BRANCHES[0] * len(rows)
    assert joined[160] <= 2.5 * joined[80]


def test_stage_joins_by_node_within_the_rows(spark, documents, small_nodes):
    rows = groups(160)
    joined, got = joined_by_node(spark, lambda: sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()))
    assert got == sorted({c for _, _, c in brute(rows, 80)})
    assert 0 < joined <= 2 * near_dup.TREES * near_dup.BRANCHES[0] * len(rows)
