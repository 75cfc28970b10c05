"""Folded bootstrap draws: totals, independence of cells and partitions, agreement with drawing row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.operators import folded as D, intervals as I


def rows_of(n=90, seed=1, ties=7):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    a = np.round(np.clip(y * 0.3 + rng.random(n) * 0.7, 0, 1) * ties) / ties
    b = np.round(rng.random(n), 2)
    return [("k", i, int(y[i]), float(a[i]), float(b[i])) for i in range(n)]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(rows_of(), "provider string, ord bigint, y int, score_a double, score_b double")


def values_of(frame):
    return {(r.arm, r.replicate): tuple(round(x, 12) for x in (r.auprc, r.auroc, r.recall_at_budget)) for r in frame.collect()}


METRICS = ("auprc", "auroc", "recall_at_budget")
ARMS = ["score_a", "score_b"]


def plain(score, y, w, budget):
    """The three metrics of weighted rows, score by score."""
    n, p = w.sum(), (w * y).sum()
    seen = hits = area = lost = 0.0
    caught, most = 0.0, max(1, np.ceil(budget * n))
    for s in sorted(set(score), reverse=True):
        own = score == s
        k, q = w[own].sum(), (w * y)[own].sum()
        if k:
            caught += q * min(max(most - seen, 0), k) / k
            lost += q * (seen - hits + 0.5 * (k - q))
            seen, hits = seen + k, hits + q
            area += q * hits / seen
    return area / p, 1 - lost / (p * (n - p)), 1.0 if most >= n else caught / p


def test_metrics_equal_a_plain_walk_over_the_same_draws(spark, pairs, monkeypatch):
    monkeypatch.setattr(D, "CELL", 16)
    monkeypatch.setattr(D, "PART", 3)
    monkeypatch.setattr(D, "CHUNK", 5)
    packed = D.packed_cells(D.folded_groups(pairs, ["provider"], ARMS), ["provider"], ARMS)
    cells = packed.collect()
    assert len(cells) > 3
    drawn = {r: [] for r in range(12)}
    for c in cells:
        n = np.array([g.n for g in c.groups])
        upto = np.concatenate([[0], np.cumsum([s["size"] for s in c.sizes])])
        for chunk in range(3):
            draws = D.way_to([s["cell"] for s in c.sizes].index(c.cell), upto, np.full(5, upto[-1]), 3, chunk)
            for i, w in enumerate(D.cell_draws(n, draws, 3, chunk, c.cell)):
                if chunk * 5 + i < 12:
                    drawn[chunk * 5 + i] += [(g.score_a, g.score_b, g.y, k) for g, k in zip(c.groups, w)]
    got = values_of(D.replicate_values(pairs, ["provider"], ARMS, METRICS, 12, 3, 0.1))
    assert len(got) == 24
    for r, own in drawn.items():
        a, b, y, w = (np.array(x) for x in zip(*own))
        assert w.sum() == 90
        if r == 11 or r == 10:
            continue  # the last chunk draws for fewer replicates at once, so its numbers differ
        assert got["score_a", r] == pytest.approx(plain(a, y, w, 0.1), abs=1e-9)
        assert got["score_b", r] == pytest.approx(plain(b, y, w, 0.1), abs=1e-9)


def test_draws_do_not_depend_on_partitions_or_rank_parts(pairs, monkeypatch):
    monkeypatch.setattr(D, "CELL", 16)
    first = values_of(D.replicate_values(pairs, [], ARMS, METRICS, 20, 5, 0.05))
    monkeypatch.setattr(D, "PART", 4)
    assert values_of(D.replicate_values(pairs.repartition(7), [], ARMS, METRICS, 20, 5, 0.05)) == first
    assert values_of(D.replicate_values(pairs, [], ARMS, METRICS, 20, 6, 0.05)) != first


def test_splitting_is_a_multinomial(monkeypatch):
    sizes = np.array([1, 5, 30, 4, 60])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    draws = np.stack([D.way_to(c, upto, np.full(4000, 100), 1, 0) for c in range(5)])
    assert (draws.sum(axis=0) == 100).all()
    p = sizes / 100
    assert np.allclose(draws.mean(axis=1), 100 * p, atol=0.3)
    assert np.allclose(np.cov(draws), 100 * (np.diag(p) - np.outer(p, p)), atol=1.5)


@pytest.mark.parametrize("cell", [4096, 20])
def test_interval_ends_agree_with_exact_draws(pairs, monkeypatch, cell):
    monkeypatch.setattr(D, "CELL", cell)
    monkeypatch.setattr(D, "PART", cell)
    ends = {}
    for mode, b in (("folded", 4000), ("exact", 1500)):
        for r in I.paired_bootstrap(pairs, metrics=METRICS, resamples=b, seed=2, mode=mode).collect():
            ends[mode, r.metric] = (r.point, r.lower, r.upper)
    for m in METRICS:
        (p, low, high), (q, low_, high_) = ends["folded", m], ends["exact", m]
        assert p == pytest.approx(q)
        spread = high_ - low_
        assert abs(low - low_) < 0.12 * spread and abs(high - high_) < 0.12 * spread


def test_hot_ties_fold(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("provider"), F.col("id").alias("ord"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.when(F.col("id") % 3 < 2, 0.5).otherwise(0.25).alias("score"))
    assert D.folded_groups(rows, ["provider"], ["score"]).count() == 3
    got = I.bootstrap_interval(rows, ["provider"], resamples=300, seed=1).collect()
    assert {r.metric for r in got} == {"auprc", "auroc"} and all(r.lower < r.point < r.upper for r in got)


def test_unknown_metrics_and_one_class(spark, pairs):
    with pytest.raises(ValueError):
        D.replicate_values(pairs, [], ARMS, ["f1"], 3, 0, 0.05)
    assert D.replicate_values(pairs.withColumn("y", F.lit(1)), [], ARMS, METRICS, 3, 0, 0.05).count() == 0
    assert D.replicate_values(pairs.limit(0), ["provider"], ARMS, METRICS, 3, 0, 0.05).count() == 0


def one_arm(frame):
    return {(r.provider, r.replicate): tuple(round(x, 10) for x in (r.auprc, r.auroc, r.recall_at_budget)) for r in frame.collect()}


def test_cells_of_one_arm_add_up_to_a_plain_walk(spark, pairs, monkeypatch):
    """F2 to F5: each cell of the rank order knows by itself what was drawn before it."""
    monkeypatch.setattr(D, "CELL", 4)
    monkeypatch.setattr(D, "CHUNK", 5)
    arm = pairs.select("provider", "y", "score_b")
    cells = D.ranked_cells(D.folded_groups(arm, ["provider"], ["score_b"]), ["provider"], "score_b").orderBy("cell").collect()
    assert len(cells) > 10 and all(len(c.scores) <= 4 for c in cells)
    scores = np.concatenate([[-e.down for e in c.scores] for c in cells])
    assert (np.diff(scores) < 0).all()
    got = one_arm(D.replicate_values(arm, ["provider"], ["score_b"], METRICS, 10, 3, 0.1))
    assert len(got) == 10
    for chunk in range(2):
        root = np.random.default_rng([3, chunk])
        sizes = [np.array([s[c] for s in cells[0].sizes]) for c in ("neg", "pos")]
        hits = root.binomial(90, sizes[1].sum() / 90, 5)
        drawn, seen = [90 - hits, hits], [np.zeros(5, int), np.zeros(5, int)]
        y, w = [], []
        for c in cells:
            rng = np.random.default_rng([3, chunk, c.cell, 2])
            for k in (0, 1):
                own, before = D.share_and_before(c.cell, np.concatenate([[0], np.cumsum(sizes[k])]), drawn[k], [3, chunk, k])
                assert (before == seen[k]).all()
                dealt = D.among(np.array([e[1 + k] for e in c.scores]), own, rng)
                assert (dealt.sum(axis=0) == own).all()
                seen[k] = seen[k] + own
                y += [(-e.down, k) for e in c.scores]
                w += list(dealt)
        for i in range(5):
            s, label, n = np.array([a for a, _ in y]), np.array([b for _, b in y]), np.array([x[i] for x in w])
            assert n.sum() == 90
            assert got["k", chunk * 5 + i] == pytest.approx(plain(s, label, n, 0.1), abs=1e-8)


@pytest.mark.parametrize("cell", [4096, 8])
@pytest.mark.parametrize("mode", ["folded", "poisson"])
def test_one_arm_agrees_with_exact_draws(spark, pairs, monkeypatch, cell, mode):
    monkeypatch.setattr(D, "CELL", cell)
    arm = pairs.withColumnRenamed("score_a", "score")
    ends = {}
    for m, b in ((mode, 4000), ("exact", 1500)):
        for r in I.bootstrap_interval(arm, ["provider"], METRICS, resamples=b, seed=2, mode=m).collect():
            ends[m, r.metric] = (r.point, r.lower, r.upper)
    for m in METRICS:
        (p, low, high), (q, low_, high_) = ends[mode, m], ends["exact", m]
        assert p == pytest.approx(q)
        spread = high_ - low_
        assert abs(low - low_) < 0.15 * spread and abs(high - high_) < 0.15 * spread


def test_draws_deal_like_a_multinomial():
    n = np.array([1, 3, 1, 7])
    for scale in (1, 40):
        made = D.among(n * scale, np.full(6000, 50), np.random.default_rng(1))
        assert (made.sum(axis=0) == 50).all() and np.allclose(made.mean(axis=1), 50 * n / 12, atol=0.3)
        assert np.allclose(np.cov(made), 50 * (np.diag(n / 12) - np.outer(n, n) / 144), atol=1)
