"""Array draws: the digest, and the row-by-row plan."""

import hashlib
import math

import numpy as np
import pytest

from tracegauge.operators import draws as D, intervals as I

METRICS = ("auprc", "auroc", "recall_at_budget")


@pytest.mark.parametrize("n,seed", [(1, 0), (11, 7), (1234, 20_260_919)])
def test_drawn_rows_follow_the_digest(n, seed):
    draw = D.drawn_rows(n, seed)
    for replicate in (0, 7, 10, 99, 100, 1000, 9999, 123_456):
        want = [int(hashlib.md5(f"{seed}:{replicate}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert draw(replicate).tolist() == want


def test_a_text_of_two_blocks_is_refused():
    with pytest.raises(ValueError, match="one block"):
        list(D.tails(5, 55))


def odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("a", 40), ("b", 37), ("c", 1), ("d", 12)):
        for i in range(n):
            a = [None, math.nan, math.inf, -0.0, 0.0, 0.5][rng.integers(0, 6)] if key == "a" else float(rng.integers(0, 9)) / 8
            rows.append((key, 3 * i - 7, 1 if key == "d" else int(rng.integers(0, 2)), a, float(rng.random())))
    return spark.createDataFrame(rows, "k string, ord bigint, y int, score_a double, score_b double").repartition(5)


def test_array_draws_equal_row_draws(spark, monkeypatch):
    rows, arms = odd_rows(spark), ["score_a", "score_b"]
    got = {}
    for most in (D.DENSE_ROWS, 0):
        monkeypatch.setattr(D, "DENSE_ROWS", most)
        values = I.replicate_values(rows, ["k"], arms, METRICS, 23, 5, budget=0.1, portable=True)
        got[most] = {tuple(r[:3]): tuple(r[3:]) for r in values.collect()}
    dense, sparse = got.values()
    assert dense.keys() == sparse.keys() and len(dense) > 80
    for key, values in dense.items():
        assert values == pytest.approx(sparse[key], abs=1e-12)


def test_draws_do_not_leave_their_task(spark):
    """Rows are shuffled once a chunk; what leaves a chunk is a row per replicate and arm, not one per draw."""
    values = I.replicate_values(odd_rows(spark), ["k"], ["score_a", "score_b"], METRICS, 300, 5, portable=True)
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Generate explode") == 1
