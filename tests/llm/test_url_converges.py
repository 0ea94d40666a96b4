import pytest

from sieveline.llm.url_filter import TOLERANCE, propagate
from tests.llm.test_url_filter import brute_scores

EDGES = [("a", "b", 1), ("b", "a", 1), ("b", "c", 3), ("c", "a", 2)]
SEEDS = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 1.0)}


def frames(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, n long"), spark.createDataFrame([(h, *s) for h, s in SEEDS.items()], "host string, trust_seed double, distrust_seed double")


def test_a_cycle_meets_the_tolerance(spark):
    want = brute_scores(EDGES, SEEDS, 400)
    for r in propagate(*frames(spark)).collect():
        # a move of at most TOLERANCE leaves TOLERANCE * 0.85 / 0.15 to go, in sum over the three hosts
        assert abs(r.trust - want[r.host][0]) < 20 * TOLERANCE and abs(r.distrust - want[r.host][1]) < 20 * TOLERANCE


def test_a_bound_too_low_raises(spark):
    with pytest.raises(RuntimeError, match="after 30 iterations"):
        propagate(*frames(spark), max_iterations=30)
