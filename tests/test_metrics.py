"""Ranking, calibration and operational metrics against hand-worked and brute-force values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.operators import calibration as C, faults as L, joins as J, operational as O, ranking as R, running as N
from tracegauge.schemas import IntegrityError

ARM = ["provider"]


def scored(spark, arms):
    rows = [(arm, i, int(y), float(s)) for arm, (ys, ss) in arms.items() for i, (y, s) in enumerate(zip(ys, ss, strict=True))]
    return spark.createDataFrame(rows, "provider string, ord bigint, y int, score double")


def by_arm(df):
    return {r["provider"]: r.asDict() for r in df.collect()}


def brute(y, s, budget):
    y, s = np.array(y), np.array(s, dtype=float)
    p, n = int(y.sum()), len(y)
    ap = auc = None
    if 0 < p < n:
        ap, seen, hits = 0.0, 0, 0
        for t in sorted(set(s.tolist()), reverse=True):
            m = s == t
            seen, hits = seen + int(m.sum()), hits + int(y[m].sum())
            ap += y[m].sum() / p * hits / seen
        pos, neg = s[y == 1], s[y == 0]
        auc = float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))
    rec = None
    if p:
        k = max(1, math.ceil(budget * n))
        if k >= n:
            rec = 1.0
        else:
            cut = np.sort(s)[::-1][k - 1]
            above, tied = s > cut, s == cut
            rec = (y[above].sum() + y[tied].sum() * (k - above.sum()) / tied.sum()) / p
    return ap, auc, rec


def brute_ece(y, s, bins):
    order = np.argsort(s, kind="stable")
    edges = np.linspace(0, len(y), bins + 1).astype(int)
    y, s = np.array(y), np.array(s)
    return sum(
        (b - a) / len(y) * abs(y[order[a:b]].mean() - s[order[a:b]].mean()) for a, b in zip(edges, edges[1:], strict=False) if b > a
    )


@pytest.fixture(scope="module")
def arms():
    rng = np.random.default_rng(5)
    n = 237
    y = rng.integers(0, 2, n)
    return {
        "smooth": (y, np.clip(rng.random(n) * 0.7 + y * 0.3, 0, 1)),
        "coarse": (y, np.round(np.clip(rng.random(n) * 0.7 + y * 0.3, 0, 1), 1)),
        "ends": (y, np.where(rng.random(n) < 0.4, 0.0, np.where(rng.random(n) < 0.5, 1.0, rng.random(n) * 1e-9))),
        "one_class": (np.zeros(20, dtype=int), rng.random(20)),
        "constant": (y[:50], np.full(50, 0.25)),
        "outside": (y, rng.normal(size=n) * 5),
    }


def test_ranking_matches_brute_force(spark, arms):
    table = R.ranked_groups(R.score_groups(scored(spark, arms), ARM), ARM)
    got = by_arm(R.ranking_metrics(table, ARM, (0.05, 0.2)))
    for arm, (y, s) in arms.items():
        ap, auc, r5 = brute(y, s, 0.05)
        assert got[arm]["auprc"] == (None if ap is None else pytest.approx(ap, abs=1e-12)), arm
        assert got[arm]["auroc"] == (None if auc is None else pytest.approx(auc, abs=1e-12)), arm
        assert got[arm]["recall_at_5"] == (None if r5 is None else pytest.approx(r5, abs=1e-12)), arm


@pytest.mark.parametrize("parts", [1, 7])
def test_repartitioning_changes_nothing(spark, arms, parts):
    rows = scored(spark, arms)
    want = by_arm(R.ranking_metrics(R.ranked_groups(R.score_groups(rows, ARM), ARM), ARM))
    got = by_arm(R.ranking_metrics(R.ranked_groups(R.score_groups(rows.orderBy(F.rand(3)).repartition(parts), ARM), ARM), ARM))
    for arm in want:
        for name, value in want[arm].items():
            assert got[arm][name] == (value if value is None or isinstance(value, str) else pytest.approx(value, abs=1e-12))


@pytest.mark.parametrize("bins", [2, 10])
def test_calibration_matches_brute_force(spark, arms, bins):
    got = by_arm(C.ece(C.reliability_bins(scored(spark, arms), ARM, bins=bins), ARM))
    for arm, (y, s) in arms.items():
        assert got[arm]["ece"] == pytest.approx(brute_ece(y, s, bins), abs=1e-9), arm


def test_hand_worked_confusion(spark):
    rows = scored(spark, {"a": ([1, 1, 0, 0, 1], [0.9, 0.4, 0.8, 0.1, 0.7])})
    got = by_arm(R.confusion(rows, ARM, F.lit(0.5)))["a"]
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2, 1, 1, 1)
    assert got["precision"] == got["recall"] == got["f1"] == pytest.approx(2 / 3)
    assert got["fpr"] == 0.5
    empty = by_arm(R.confusion(scored(spark, {"a": ([0, 0], [0.1, 0.2])}), ARM, F.lit(0.5)))["a"]
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)


def test_recall_at_budget_by_hand(spark):
    rows = scored(spark, {"a": ([1, 1] + [0] * 8, [0.99, 0.98] + [0.1] * 8), "ties": ([1, 0, 0, 0], [0.5] * 4)})
    table = R.ranked_groups(R.score_groups(rows, ARM), ARM)
    got = {(r["provider"], r["budget"]): (r["recall"], r["ceiling"]) for r in R.recall_at_budgets(table, ARM, (0.1, 0.2, 0.25)).collect()}
    assert got[("a", 0.2)] == (1.0, 1.0)
    assert got[("a", 0.1)] == (0.5, 0.5)
    assert got[("ties", 0.25)][0] == 0.25


def test_ece_by_hand(spark):
    rows = scored(spark, {"exact": ([0] * 50 + [1] * 50, [0.0] * 50 + [1.0] * 50), "bad": ([0] * 100, [0.9] * 100)})
    got = by_arm(C.ece(C.reliability_bins(rows, ARM, bins=2), ARM))
    assert got["exact"]["ece"] == pytest.approx(0.0)
    assert got["bad"]["ece"] == pytest.approx(0.9)


def test_selective_accuracy(spark):
    rows = [("a", i, "x", "x" if i < 5 else "y", 0.9 if i < 5 else 0.1) for i in range(10)] + [("none", 0, "x", "x", None)]
    df = spark.createDataFrame(rows, "provider string, ord bigint, label string, predicted_label string, confidence double")
    got = {r["escalated_fraction"]: (r["kept"], r["accuracy"]) for r in C.selective_accuracy(df, ARM, fractions=(0.0, 0.5)).collect()}
    assert got == {0.0: (10, 0.5), 0.5: (5, 1.0)}


def test_prior_shift(spark):
    df = spark.createDataFrame([("a", 0.8, 0.1), ("b", 0.8, 0.0)], "provider string, recall double, fpr double")
    got = {(r["provider"], r["prevalence"]): r for r in R.prior_shift(df, ARM, (0.05,)).collect()}
    assert got[("a", 0.05)]["projected_precision"] == pytest.approx(0.04 / 0.135)
    assert got[("b", 0.05)]["degenerate"]


def test_repeats_and_operations(spark):
    p = spark.createDataFrame(
        [("a", "t", "unsupported_success", 0.5), ("a", "t", "unsupported_success", 0.5), ("a", "t", "no_success_claim", 0.5)],
        "provider string, trace_id string, predicted_label string, primary_score double",
    )
    got = by_arm(O.repeat_stability(p, ARM))["a"]
    assert got["max_repeats"] == 3
    assert got["mean_label_agreement"] == pytest.approx(2 / 3)
    assert got["mean_score_variance"] == 0.0
    ops = spark.createDataFrame(
        [("a", None, 1, 10, 1, 0.1), ("a", "ParseFailureError: x", 1, 10, 1, None), ("a", None, 2, 10, 1, 0.2)],
        "provider string, error string, n_attempts int, input_tokens bigint, output_tokens bigint, cost_usd double",
    )
    got = by_arm(O.operational_summary(ops, ARM))["a"]
    assert (got["error_count"], got["parse_failure_count"], got["retry_count"]) == (1, 1, 1)
    assert (got["total_input_tokens"], got["cost_unpriced_predictions"]) == (30, 1)
    assert got["total_cost_usd"] == pytest.approx(0.3)
    assert by_arm(O.run_manifest(ops, ARM))["a"]["total_cost_usd"] is None


def test_point_predictions_fall_back_only_without_any_zero(spark):
    rows = [("a", "t1", 0, 1, 0.1), ("a", "t1", 0, 2, 0.2), ("a", "t2", 1, 3, 0.3), ("b", "t1", 2, 5, 0.5), ("b", "t1", 1, 4, 0.4)]
    df = spark.createDataFrame(rows, "provider string, trace_id string, repeat_no int, arrival bigint, primary_score double")
    got = {(r["provider"], r["trace_id"]): r["primary_score"] for r in J.point_predictions(df).collect()}
    assert got == {("a", "t1"): 0.2, ("b", "t1"): 0.4}


def test_orphan_prediction_is_refused(spark):
    truth = spark.createDataFrame([("t1", "no_success_claim")], "trace_id string, label string")
    points = spark.createDataFrame([("a", "t1", 0.1), ("a", "lost", 0.2)], "provider string, trace_id string, primary_score double")
    with pytest.raises(IntegrityError):
        J.score_join(points, truth)


def test_pairing_keeps_gaps_apart(spark):
    rows = [("x", t, i, 1, 0.1 * i) for i, t in enumerate("acd")] + [("y", t, i, 1, 0.2) for i, t in enumerate("abcd")]
    df = spark.createDataFrame(rows, "provider string, trace_id string, ord bigint, y int, score double")
    pairs = J.pair_arms(df, "x", "y")
    assert sorted(r["trace_id"] for r in J.paired(pairs).collect()) == ["a", "c", "d"]
    assert [r["trace_id"] for r in J.unpaired(pairs).collect()] == ["b"]


def test_lane_rate_over_nothing_is_null(spark):
    table = spark.createDataFrame([("t", "unsupported_success", "f", False, False)], "trace_id string, label string, fault_type string, a_scored boolean, a_flagged boolean")
    row = L.lane_summary(table, ("a",)).first()
    assert (row["flagged"], row["scored"], row["rate"]) == (0, 0, None)


def test_running_totals_split_a_hot_cell(spark):
    n = 5000
    rows = spark.range(n).select(F.lit("k").alias("k"), (0.5 + F.col("id") * 1e-15).alias("score"), F.lit(1).cast("bigint").alias("n"))
    folded = rows.groupBy("k", "score").agg(F.sum("n").alias("n"))
    out = N.running_totals(folded, ["k"], ["score"], ["n"], N.score_cells(), descending=True)
    top = out.agg(F.sum(F.col("before_n") * F.col("n")), F.max("total_n"), F.min("before_n")).first()
    counts = [r["n"] for r in folded.orderBy(F.col("score").desc()).collect()]
    want, seen = 0, 0
    for c in counts:
        want += seen * c
        seen += c
    assert tuple(top) == (want, n, 0)


def test_unknown_metric_is_refused():
    with pytest.raises(ValueError):
        R.metric_by_name("accuracy")


def test_points_of_an_arm_are_not_dealt_by_arm(spark):
    """F17 to F23: without an automatic broadcast the join with the arms still moves no points."""
    rows = spark.createDataFrame([("a", "t1", 0, 1, 0.1)], "provider string, trace_id string, repeat_no int, arrival bigint, primary_score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J.point_predictions(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
