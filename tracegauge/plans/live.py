"""Queries that run the streaming operators over the given tables to the end."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..operators import gates as G
from ..streaming import live as T
from ..session import settle
from . import corpus
from .corpus import SCORED, with_views
from .decisions import _BASE, _DIFF, _boot_sql, verdict
from .lanes import LANE
from .registry import query
from .scoring import threshold


def prediction_stream(spark, sf) -> DataFrame:
    """The predictions view over a stream of line-item files."""
    schema = corpus.base(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return spark.sql(re.sub(r"\{lineitem\}", "{lines}", corpus.VIEWS["predictions"]), lines=lines)


def truth(spark, sf):
    return corpus.view(spark, sf, "truth").drop("ord")


@query("t1_t2_live_rows", with_views("truth predictions thresholds", """SELECT p.trace_id, p.provider, p.repeat_no, p.model_id, round(p.primary_score, 6) AS score,
CASE WHEN p.error IS NOT NULL THEN 'error' WHEN p.primary_score >= h.threshold THEN 'flag' ELSE 'pass' END AS decision, coalesce(p.input_tokens, 0) AS input_tokens, p.error, t.label, t.fault_type
FROM predictions p JOIN thresholds h ON p.provider = h.provider LEFT JOIN truth t ON p.trace_id = t.trace_id"""))
def live_rows(spark, sf):
    rows = prediction_stream(spark, sf).withColumns({"needs_review": F.col("primary_score"), "cost_usd": F.lit(None).cast("double")})
    public = T.live_rows(rows, truth(spark, sf), threshold())
    return T.drain_append(public, "live-rows").select("trace_id", "provider", "repeat_no", "model_id", "score", "decision", "input_tokens", "error", "label", "fault_type")


_COUNTS = """, j AS (SELECT p.*, t.label, t.fault_type, h.threshold FROM predictions p JOIN truth t ON p.trace_id = t.trace_id JOIN thresholds h ON p.provider = h.provider)"""


def counts(spark, sf):
    joined = prediction_stream(spark, sf).join(truth(spark, sf), "trace_id", "inner").withColumn("threshold", threshold())
    return T.drain_state(T.snapshot_counts(joined), "snapshot")


@query("t3_live_snapshot_counts", with_views("truth predictions thresholds", _COUNTS + """ SELECT provider, label, fault_type, count(*) AS predictions, count(*) FILTER (WHERE repeat_no = 0 AND primary_score IS NOT NULL) AS scored,
count(*) FILTER (WHERE repeat_no = 0 AND primary_score >= threshold) AS flagged, count(error) AS errors, count(*) FILTER (WHERE contains(error, 'ParseFailure')) AS parse_failures,
CAST(sum(greatest(n_attempts - 1, 0)) AS BIGINT) AS retries, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM j GROUP BY ALL"""))
def snapshot_counts(spark, sf):
    return counts(spark, sf)


@query("t3_live_snapshot", with_views("truth predictions thresholds", _COUNTS + """, c AS (SELECT provider, count(*) AS predictions, count(*) FILTER (WHERE repeat_no = 0 AND label = 'unsupported_success' AND primary_score >= threshold) AS tp,
count(*) FILTER (WHERE repeat_no = 0 AND label <> 'unsupported_success' AND primary_score >= threshold) AS fp, count(*) FILTER (WHERE repeat_no = 0 AND label = 'unsupported_success' AND primary_score < threshold) AS fn,
count(*) FILTER (WHERE repeat_no = 0 AND label <> 'unsupported_success' AND primary_score < threshold) AS tn, count(error) AS errors FROM j GROUP BY provider)
SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(CAST(errors AS DOUBLE) / predictions, 6) AS error_rate FROM c"""))
def snapshot(spark, sf):
    return T.snapshot(counts(spark, sf))


@query("t4_late_repeat_points", with_views("predictions zero_repeat points", "SELECT provider, trace_id, repeat_no, model_id, round(primary_score, 6) AS primary_score FROM points"))
def late_repeats(spark, sf):
    rows = prediction_stream(spark, sf).select("provider", "trace_id", "repeat_no", "arrival", "model_id", "primary_score")
    state = T.drain_updates(T.repeat_state(rows), ["provider", "trace_id"], "repeats")
    return T.choose_points(state).select("provider", "trace_id", "repeat_no", "model_id", "primary_score")


@query("t5_run_status", with_views("runs predictions", """, w AS (SELECT run_id, count(*) AS written FROM predictions GROUP BY run_id), e AS (SELECT run_id, concurrency * 140 AS expected FROM runs)
SELECT r.run_id, r.status, coalesce(w.written, 0) AS written, expected, r.status = 'complete' AND coalesce(w.written, 0) >= expected AS finished FROM runs r LEFT JOIN w ON r.run_id = w.run_id LEFT JOIN e ON r.run_id = e.run_id"""))
def run_status(spark, sf):
    runs = corpus.view(spark, sf, "runs")
    expected = runs.select("run_id", (F.col("concurrency") * 140).alias("expected"))
    return T.run_status(runs, corpus.view(spark, sf, "predictions"), expected)


@query("t6_deferred_statistics", with_views(SCORED + " runs", _BASE + _boot_sql("score_a score_b") + _DIFF + f""", q AS (SELECT quantile_cont(auprc, 0.025) AS lo, quantile_cont(auprc, 0.975) AS hi FROM diff)
SELECT run_id, status, CASE WHEN status <> 'complete' OR provider <> '{LANE}' THEN 'pending' ELSE (SELECT CASE WHEN lo IS NULL THEN 'not_computable' WHEN lo > 0 THEN 'wins' WHEN hi < 0 THEN 'loses' ELSE 'no_difference' END FROM q) END AS verdict FROM runs"""))
def deferred(spark, sf):
    """A live snapshot beside a comparison that a bootstrap has written; runs that have none yet are pending."""
    runs = corpus.view(spark, sf, "runs")
    said = verdict(spark, sf).select("verdict", F.lit(LANE).alias("provider"))
    written = settle(runs.where("status = 'complete'").join(said, "provider").select("run_id", "verdict"), "comparison")
    return G.deferred(runs.select("run_id", "status"), written)


@query("t8_streaming_error_guard", with_views("predictions", "SELECT run_id, count(*) AS total, count(error) AS failed FROM predictions GROUP BY run_id HAVING count(*) >= 20 AND CAST(count(error) AS DOUBLE) / count(*) > 1e-2"))
def error_guard(spark, sf):
    state = T.drain_state(T.error_counts(prediction_stream(spark, sf)), "errors")
    return T.over_error_budget(state, max_rate=0.01)
