"""Queries over small surfaces: allow list, range check, replay and hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as P
from ..operators import sets as U
from ..session import work_folder
from ..streaming import live as T
from . import corpus
from .corpus import with_views
from .registry import query


@query("u8_allow_list", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr', 'none') GROUP BY lang")
def allow_list(spark, sf):
    found = corpus.base(spark, sf, "documents").select("lang")
    return U.allow_list(found, "lang", ("en", "fr", "none")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("p12_probability_range", with_views("predictions", """, s AS (SELECT trace_id, provider, repeat_no, CASE WHEN arrival % 5 = 0 THEN primary_score + 1 WHEN arrival % 7 = 0 THEN -1e-1 ELSE primary_score END AS value FROM predictions)
SELECT trace_id, provider, repeat_no, CASE WHEN value IS NULL THEN 'score is not a number' WHEN value < 0 OR value > 1 THEN 'score is outside [0, 1]' END AS problem FROM s"""))
def probability_range(spark, sf):
    value = F.when(F.col("arrival") % 5 == 0, F.col("primary_score") + 1).when(F.col("arrival") % 7 == 0, -0.1).otherwise(F.col("primary_score"))
    rows = corpus.view(spark, sf, "predictions").withColumn("value", value)
    checks = P.probability_error(F.col("value"), "score")
    return rows.select("trace_id", "provider", "repeat_no", F.coalesce(*[F.when(bad, text) for bad, text in checks]).alias("problem"))


FILES = 4


@query("t7_x3_replay_with_hook", with_views("predictions", f"""SELECT run_id, count(*) AS total, count(error) AS failed, {FILES} AS batches, (SELECT count(*) FROM predictions) AS replayed FROM predictions GROUP BY run_id"""))
def replay(spark, sf):
    """A finished run of four files, each written in parts, replayed a file at a time; the hook sees the state after every batch."""
    rows = corpus.view(spark, sf, "predictions").select("run_id", "trace_id", "provider", "repeat_no", "primary_score", "error", "arrival")
    folder = work_folder(spark, "finished")
    lines = rows.withColumn("value", F.to_json(F.struct(*[c for c in rows.columns if c != "arrival"]))).withColumn("part", F.pmod("arrival", F.lit(FILES)))
    lines.select("value", "part").hint("rebalance", "part").write.partitionBy("part").text(folder)
    seen = []
    counts = T.error_counts(T.good_rows(T.replay(spark, folder, parts=True)))
    state = T.drain_state(counts, "replayed", lambda batch, n: seen.append(batch.agg(F.sum("total")).first()[0]))
    return state.withColumns({"batches": F.lit(len(seen)).cast("int"), "replayed": F.lit(max(seen, default=0)).cast("bigint")})
