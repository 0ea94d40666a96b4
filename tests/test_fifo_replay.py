import random

import pytest

from sieveline.operators.cache import fifo_replay
from sieveline.plans import QUERIES


def plain(puts, capacity):
    held = {}
    for k, at in puts:
        if len(held) > capacity:
            del held[next(iter(held))]
        held[k] = held.get(k, at)
    return sorted(held.items())


@pytest.mark.parametrize("capacity", [0, 1, 5, 40])
def test_replay_with_returning_keys(spark, capacity):
    rng = random.Random(capacity)
    puts = [(rng.randrange(30), at) for at in range(2000)]
    rows = rng.sample(puts, len(puts))
    got = fifo_replay(spark.createDataFrame(rows, "k long, at long").repartition(4), "k", "at", capacity)
    assert sorted(map(tuple, got.collect())) == plain(puts, capacity)


def test_query_on_the_events_table(spark):
    d = "/root/testdata/sf0.01"
    puts = sorted((r.event_id, r.user_id) for r in spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id").collect())
    got = sorted((r.user_id, r.first) for r in QUERIES["fifo_evict"][0](spark, d).collect())
    assert got == plain([(u, e) for e, u in puts], 50)
    firsts = {}
    for e, u in puts:
        firsts.setdefault(u, e)
    assert dict(got) != dict(sorted(firsts.items(), key=lambda x: -x[1])[:51])  # keys do come back after their eviction


def test_no_puts(spark):
    assert fifo_replay(spark.createDataFrame([], "k string, at long"), "k", "at", 3).count() == 0
