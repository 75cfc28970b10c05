"""Exact quantiles by cells against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.operators import operational as O, quantiles as Q

SHARES, NAMES = (0.0, 0.5, 0.95, 0.99, 1.0), ("a", "b", "c", "d", "e")


def test_quantiles_equal_numpy_for_all_keys_at_once(spark):
    rng = np.random.default_rng(3)
    values = {
        "wide": rng.lognormal(3, 4, 400), "one": np.array([7.25]), "two": np.array([1.0, 2.0]), "tied": np.full(300, 12.5), "near": 100 + rng.random(300) * 1e-7,
        "signs": rng.normal(0, 1, 301), "zeros": np.array([0.0] * 50 + [1e-9, -1e-9, 5.0]), "steps": rng.integers(0, 5, 200).astype(float),
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("wide", None), ("null", None)], "k string, v double")
    got = {r.k: tuple(r[n] for n in NAMES) for r in Q.quantiles(rows.repartition(7), ["k"], "v", SHARES, NAMES).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, SHARES)), rel=1e-12, abs=1e-15), k


def test_only_cells_with_a_wanted_rank_are_ordered(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") + 1).cast("double").alias("v"))
    assert Q.quantiles(rows, ["k"], "v", (0.5, 0.9), ("a", "b")).first()[1:] == (20_000.5, 36_000.1, 40_000, 40_000 * 40_001 / 2)
    assert Q.quantiles(rows.limit(0), ["k"], "v", (0.5,), ("a",)).count() == 0


def test_latency_summary_keeps_its_columns(spark):
    rows = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("x", 0.0), ("y", -1.0)], "provider string, latency_ms double")
    got = O.latency_summary(rows, ["provider"]).collect()
    assert [r.asDict() for r in got] == [{"provider": "x", "p50_ms": 15.0, "p95_ms": 19.5, "p99_ms": pytest.approx(19.9), "mean_ms": 15.0, "total_s": 0.03, "throughput_per_s": pytest.approx(2 / 0.03)}]
