"""Streams equal their batch twins; half-written and late rows are handled."""

import json

import pytest
from pyspark.sql import functions as F

from tracegauge.operators import joins as J
from tracegauge.streaming import live as T


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def prediction(i, repeat=0, score=0.5, error=None, provider="p"):
    return {"run_id": "r1", "trace_id": f"t{i}", "provider": provider, "model_id": "m", "repeat_no": repeat, "primary_score": score, "error": error,
            "latency_ms": float(i * 10 + repeat), "input_tokens": 1}


@pytest.fixture()
def folder(tmp_path):
    f = tmp_path / "spark-stream"
    f.mkdir()
    (f / "part-1.json").write_text(lines([prediction(1, repeat=1, score=0.9), prediction(2)]) + '{"run_id": "r1", "trace_')
    (f / "part-2.json").write_text(lines([prediction(1, score=0.2), prediction(3, score=None, error="ParseFailureError: x")]))
    return str(f)


def test_tail_keeps_good_and_corrupt_apart(spark, folder):
    good = T.drain_append(T.good_rows(T.tail_predictions(spark, folder)).select("trace_id", "repeat_no"), "good")
    assert sorted((r[0], r[1]) for r in good.collect()) == [("t1", 0), ("t1", 1), ("t2", 0), ("t3", 0)]
    bad = T.drain_append(T.corrupt_rows(T.tail_predictions(spark, folder)), "bad")
    assert [r[0] for r in bad.collect()] == ['{"run_id": "r1", "trace_']


def test_live_rows_join_truth(spark, folder):
    truth = spark.createDataFrame([("t1", "unsupported_success", "f", "d"), ("t2", "no_success_claim", "f", "d")], "trace_id string, label string, fault_type string, domain string")
    rows = T.drain_append(T.live_rows(T.good_rows(T.replay(spark, folder)), truth, F.lit(0.5)), "rows")
    got = {(r["trace_id"], r["repeat_no"]): (r["decision"], r["label"]) for r in rows.collect()}
    assert got == {("t1", 1): ("flag", "unsupported_success"), ("t1", 0): ("pass", "unsupported_success"), ("t2", 0): ("flag", "no_success_claim"), ("t3", 0): ("error", None)}
    assert "raw_response" not in rows.columns


def test_late_repeat_zero_takes_over(spark, folder):
    stream = T.good_rows(T.replay(spark, folder)).select("provider", "trace_id", "repeat_no", "primary_score", F.col("latency_ms").alias("arrival"))
    state = T.drain_updates(T.repeat_state(stream), ["provider", "trace_id"], "late")
    got = {r["trace_id"]: r["primary_score"] for r in T.choose_points(state).collect()}
    batch = spark.read.schema(stream.schema.add("latency_ms", "double")).json(folder)
    twin = batch.where("trace_id IS NOT NULL").withColumn("arrival", F.col("latency_ms"))
    want = {r["trace_id"]: r["primary_score"] for r in J.point_predictions(twin).collect()}
    assert got == want == {"t1": 0.2, "t2": 0.5, "t3": None}


def test_hook_sees_every_batch_and_guard_fires(spark, tmp_path):
    f = tmp_path / "spark-guard"
    f.mkdir()
    for k in range(3):
        (f / f"part-{k}.json").write_text(lines([prediction(k * 20 + i, error="boom" if k == 2 and i < 9 else None) for i in range(20)]))
    seen = []
    counts = T.error_counts(T.good_rows(T.replay(spark, str(f))))
    state = T.drain_state(counts, "guard", lambda batch, n: seen.append((n, T.over_error_budget(batch).count())))
    assert [s[1] for s in sorted(seen)] == [0, 0, 1]
    assert state.first()["total"] == 60


def test_run_status(spark):
    runs = spark.createDataFrame([("a", "complete"), ("b", "running")], "run_id string, status string")
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "run_id string")
    expected = spark.createDataFrame([("a", 2), ("b", 5)], "run_id string, expected int")
    got = {r["run_id"]: (r["written"], r["finished"]) for r in T.run_status(runs, rows, expected).collect()}
    assert got == {"a": (2, True), "b": (1, False)}


def test_replay_takes_a_file_of_many_parts_in_one_batch(spark, tmp_path):
    for k, n in ((0, 3), (1, 1), (2, 7)):
        (tmp_path / f"spark-run/file={k}").mkdir(parents=True)
        for part in range(n):
            (tmp_path / f"spark-run/file={k}/part-{part}.json").write_text(lines([prediction(100 * k + 10 * part + i) for i in range(5)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # a file of the run is scanned, and laid out, by several tasks
    try:
        stream = T.replay(spark, str(tmp_path / "spark-run"), parts=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    seen = []
    T.drain_state(T.error_counts(T.good_rows(stream)), "parts", lambda batch, n: seen.append((n, batch.first()["total"])))
    assert [s[1] for s in sorted(seen)] == [15, 20, 55]
