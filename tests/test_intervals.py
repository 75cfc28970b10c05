"""Bootstrap intervals, verdicts, gates, curves and samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.functions import scores as S
from tracegauge.operators import curve as K, gates as G, intervals as I, sampling as M
from tracegauge.schemas import LABELS, IntegrityError


def arm(spark, n=80, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    good = np.clip(y * 0.4 + rng.random(n) * 0.6, 0, 1)
    noise = rng.random(n)
    rows = [("a", i, int(y[i]), float(good[i]), float(good[i]), float(noise[i])) for i in range(n)]
    return spark.createDataFrame(rows, "provider string, ord bigint, y int, score double, score_a double, score_b double")


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_interval_holds_its_point_and_repeats(spark, mode):
    rows = arm(spark)
    first = I.bootstrap_interval(rows, ["provider"], resamples=60, seed=4, mode=mode).collect()
    again = I.bootstrap_interval(rows.repartition(5), ["provider"], resamples=60, seed=4, mode=mode).collect()
    assert len(first) == 2
    for r in first:
        assert r["lower"] <= r["point"] <= r["upper"]
    key = lambda rs: sorted((r["metric"], round(r["lower"], 12), round(r["upper"], 12)) for r in rs)
    assert key(first) == key(again)


def test_exact_and_poisson_agree_in_width(spark):
    rows = arm(spark, n=300)
    widths = {}
    for mode in ("exact", "poisson"):
        got = {r["metric"]: r["upper"] - r["lower"] for r in I.bootstrap_interval(rows, ["provider"], resamples=200, seed=2, mode=mode).collect()}
        widths[mode] = got["auroc"]
    assert 0.6 < widths["exact"] / widths["poisson"] < 1.6


def test_paired_difference(spark):
    rows = arm(spark, n=200)
    got = {r["metric"]: r for r in I.paired_bootstrap(rows, metrics=("auprc", "auroc"), resamples=80, seed=3).collect()}
    assert got["auroc"]["lower"] > 0
    same = rows.withColumn("score_b", F.col("score_a"))
    zero = I.paired_bootstrap(same, metrics=("auprc",), resamples=40, seed=3).first()
    assert (zero["point"], zero["lower"], zero["upper"]) == (0.0, 0.0, 0.0)


def test_one_class_has_no_interval(spark):
    rows = arm(spark).withColumn("y", F.lit(0))
    for r in I.bootstrap_interval(rows, ["provider"], resamples=10).collect():
        assert r["point"] is None and r["lower"] is None


@pytest.mark.parametrize(
    "lower,upper,ran,want",
    [(0.1, 0.2, True, "wins"), (-0.2, -0.1, True, "loses"), (-0.1, 0.1, True, "no_difference"), (None, None, True, "not_computable"), (0.1, 0.2, False, "not_run")],
)
def test_verdicts(spark, lower, upper, ran, want):
    row = spark.createDataFrame([(lower, upper, ran)], "lower double, upper double, ran boolean")
    assert row.select(S.verdict(F.col("lower"), F.col("upper"), F.col("ran"))).first()[0] == want


def test_gates_fail_on_calibration_alone(spark):
    summary = spark.createDataFrame(
        [("a", 0.95, 0.9, 0.3, 0.0, 0, 2000), ("b", 0.95, 0.9, 0.05, 0.0, 0, 10)],
        "provider string, precision double, recall double, ece double, error_rate double, parse_failure_count int, n_records int",
    )
    base = spark.createDataFrame([("a", 0.06, 0.0), ("b", 0.06, 0.0)], "provider string, auprc_lower double, recall_delta double")
    strong = spark.createDataFrame([("a", -0.2, -0.1)], "provider string, lower double, upper double")
    got = {r["provider"]: r for r in G.gates(summary, base, strong, "rules", F.col("n_records")).collect()}
    assert not got["a"]["deployment_passed"] and not got["a"]["ece_ok"] and got["a"]["precision_ok"]
    assert got["b"]["deployment_passed"] and not got["b"]["useful_reported"] and got["b"]["useful_passed"] is None
    assert got["a"]["useful_passed"] and got["a"]["loses_to_strong"] and not got["a"]["beats_strong"]


def points(spark, means, provider="p"):
    rows = [(provider, n, s, 39, m) for n, vals in means.items() for s, m in enumerate(vals)]
    return spark.createDataFrame(rows, "provider string, n_train int, seed int, n_calibration int, auprc double")


def test_crossing_must_last(spark):
    ref = spark.createDataFrame([("r", 0.7), ("none", None)], "reference string, reference_auprc double")
    rows = points(spark, {10: [0.8] * 3, 25: [0.6] * 3, 50: [0.75] * 3, 100: [0.9] * 3})
    got = K.crossover(K.curve_summary(rows), ref).collect()
    assert len(got) == 1
    assert got[0]["mean_n"] == 50 and got[0]["beats_at_smallest"] and got[0]["reference_leads_anywhere"]


def test_missing_mean_is_not_a_crossing(spark):
    ref = spark.createDataFrame([("r", 0.7)], "reference string, reference_auprc double")
    rows = points(spark, {10: [0.8] * 3, 25: [float("nan")] * 3, 50: [0.9] * 3})
    assert K.crossover(K.curve_summary(rows), ref).first()["mean_n"] == 50


def test_curve_summary_uses_student_t(spark):
    got = {r["n_train"]: r for r in K.curve_summary(points(spark, {10: [0.5, 0.6, 0.7], 20: [0.9]})).collect()}
    assert got[10]["mean"] == pytest.approx(0.6) and got[10]["sd"] == pytest.approx(0.1)
    assert got[10]["upper"] - got[10]["mean"] == pytest.approx(4.303 * 0.1 / 3**0.5)
    assert (got[20]["sd"], got[20]["lower"], got[20]["upper"]) == (0.0, 0.9, 0.9)


def test_t_critical_between_entries(spark):
    got = spark.createDataFrame([(d,) for d in (0, 1, 11, 14, 30, 31)], "d int").select("d", S.t_critical(F.col("d")).alias("t"))
    assert {r["d"]: r["t"] for r in got.collect()} == {0: None, 1: 12.706, 11: 2.228, 14: 2.179, 30: 2.042, 31: 1.96}


def test_paid_rows_are_found(spark):
    rows = spark.createDataFrame([("rules", 0.0, 0, 0), ("rules", 0.1, 0, 0), ("rules", 0.0, 5, 0), ("typed", 0.0, 0, 0)], "provider string, cost_usd double, input_tokens bigint, output_tokens bigint")
    assert K.paid_rows(rows, ("rules",)).count() == 3


def test_largest_remainder():
    assert M.largest_remainder(dict(zip(LABELS, (8, 4, 2, 2), strict=True)), 8) == dict(zip(LABELS, (4, 2, 1, 1), strict=True))
    tight = M.largest_remainder(dict(zip(LABELS, (997, 1, 1, 1), strict=True)), 5)
    assert sum(tight.values()) == 5 and min(tight.values()) == 1
    with pytest.raises(IntegrityError):
        M.largest_remainder(dict(zip(LABELS, (8, 4, 2, 2), strict=True)), 3)


def pool(spark):
    mix = [LABELS[0]] * 8 + [LABELS[1]] * 4 + [LABELS[2]] * 2 + [LABELS[3]] * 2
    rows = [(f"t{f:02d}_{i:02d}", f * 16 + i, f"task{f:02d}", label) for f in range(20) for i, label in enumerate(mix)]
    return spark.createDataFrame(rows, "trace_id string, ord bigint, template_family string, label string")


@pytest.mark.parametrize("size", [4, 25, 100, 320])
def test_subsample_against_a_walk(spark, size):
    import hashlib

    rows = pool(spark)
    local = [r.asDict() for r in rows.orderBy("ord").collect()]
    quota = M.label_quota(rows, size)
    order = sorted({r["template_family"] for r in local}, key=lambda u: (hashlib.md5(f"9:{u}".encode()).hexdigest(), u))
    taken, have = [], dict.fromkeys(quota, 0)
    for unit in order:
        if all(have[k] >= need for k, need in quota.items()):
            break
        for r in (x for x in local if x["template_family"] == unit):
            if have[r["label"]] < quota[r["label"]]:
                taken.append(r["trace_id"])
            have[r["label"]] += 1
    got = [r["trace_id"] for r in M.subsample(rows, size, 9).collect()]
    assert sorted(got) == sorted(taken) and len(got) == size


def test_subsample_edges(spark):
    rows = pool(spark)
    assert M.subsample(rows, None, 0).count() == 320
    for bad in (0, 321):
        with pytest.raises(IntegrityError):
            M.subsample(rows, bad, 0)


def test_splits_are_disjoint_exhaustive_and_stable(spark):
    rows = pool(spark)
    first = {r["template_family"]: r["split"] for r in M.make_splits(rows, 7).collect()}
    again = {r["template_family"]: r["split"] for r in M.make_splits(rows.repartition(9), 7).collect()}
    assert first == again and len(first) == 20
    assert [list(first.values()).count(s) for s in ("dev", "validation", "test")] == [12, 4, 4]


@pytest.mark.parametrize("n,want", [(3, (1, 1)), (4, (2, 1)), (5, (3, 1)), (195, (117, 39))])
def test_split_sizes(spark, n, want):
    dev, val = M.split_sizes(F.col("n"))
    assert tuple(spark.createDataFrame([(n,)], "n bigint").select(dev, val).first()) == want


def test_systematic_sample(spark):
    rows = spark.range(103).withColumnRenamed("id", "ord")
    got = sorted(r["ord"] for r in M.systematic_sample(rows, "ord", 10).collect())
    assert got == [k * 103 // 10 for k in range(10)]
