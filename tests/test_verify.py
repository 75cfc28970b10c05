"""Run digests: order-free, one aggregate, each kind of tampering its own problem."""

import pytest
from pyspark.sql import functions as F

from tracegauge.operators import verify as V


@pytest.fixture
def tables(spark):
    p = spark.createDataFrame([(f"r{i % 3}", f"t{i}", i / 7, None if i % 4 else "e") for i in range(24)], "run_id string, trace_id string, score double, error string")
    return {"predictions": p, "attempts": p.where("error is not null").drop("score")}


def stored_of(tables, archived=False):
    return V.digests(tables).withColumn("archived", F.lit(archived))


def problems(stored, found):
    return sorted((r.run_id, r.problem) for r in V.digest_problems(stored, found).collect())


def test_order_and_partitions_do_not_matter_but_repeats_do(tables):
    want = stored_of(tables)
    moved = {n: t.select(*reversed(t.columns)).repartition(5).orderBy(F.desc("trace_id")) for n, t in tables.items()}
    assert problems(want, V.digests(moved)) == []
    twice = {**tables, "attempts": tables["attempts"].unionAll(tables["attempts"].where("trace_id = 't0'"))}
    assert problems(want, V.digests(twice)) == [("r0", "attempts_mismatch")]


@pytest.mark.parametrize(
    "change,want",
    [
        (lambda t: {**t, "predictions": t["predictions"].withColumn("score", F.when(F.col("trace_id") == "t4", 9.0).otherwise(F.col("score")))}, [("r1", "predictions_mismatch")]),
        (lambda t: {**t, "predictions": t["predictions"].where("trace_id <> 't5'")}, [("r2", "predictions_mismatch")]),
        (lambda t: {**t, "attempts": t["attempts"].where("run_id <> 'r1'")}, [("r1", "attempts_missing")]),
        (lambda t: {**t, "attempts": t["attempts"].unionAll(t["attempts"].where("trace_id = 't0'").withColumn("run_id", F.lit("r9")))}, [("r9", "attempts_foreign")]),
    ],
)
def test_each_tampering_is_named(tables, change, want):
    assert problems(stored_of(tables), V.digests(change(tables))) == want


def test_counts_and_archived_data_sets(spark, tables):
    stored = stored_of(tables).withColumn("n_rows", F.when(F.col("part") == "attempts", F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    assert problems(stored, V.digests(tables)) == [(f"r{i}", "attempts_count") for i in range(3)]
    runs = spark.createDataFrame([("r0", "d"), ("r1", "d"), ("r2", "gone")], "run_id string, dataset_id string")
    data = spark.createDataFrame([("d", "x"), ("gone", "y")], "dataset_id string, v string")
    before = V.shared_digests(runs, V.digests({"dataset": data}, "dataset_id"), "dataset_id").withColumn("archived", F.col("run_id") == "r1")
    after = V.shared_digests(runs, V.digests({"dataset": data.where("v = 'x'").withColumn("v", F.lit("z"))}, "dataset_id"), "dataset_id").where("digest is not null")
    assert problems(before, after) == [("r0", "dataset_mismatch"), ("r2", "dataset_missing")]


def test_all_checks_in_one_table(spark, tables):
    roll = spark.createDataFrame([("r0", 8, 5, 1.0), ("r1", 8, 5, None)], "run_id string, n_predictions bigint, total_input_tokens bigint, total_cost_usd double")
    again = roll.withColumn("total_input_tokens", F.lit(6).cast("bigint")).where("run_id = 'r0'").unionAll(roll.where("run_id = 'r1'"))
    costs = spark.createDataFrame([("r1", "t1", 0.5, None), ("r1", "t2", 1.0, 1.0)], "run_id string, trace_id string, cost_usd double, expected_usd double")
    got = V.verify_runs(roll, again, stored_of(tables), V.digests(tables), costs).collect()
    assert sorted((r.run_id, r.problem) for r in got) == [("r0", "total_input_tokens"), ("r1", "invented_cost")]
