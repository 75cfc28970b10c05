"""Gates, verdicts and the statements they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import verdict

# Gate limits.
STAGE_MIN_RECORDS = 1000
USEFUL_AUPRC_LOWER = 0.05
USEFUL_RECALL_POINTS = 10.0
DEPLOY_PRECISION = 0.90
DEPLOY_RECALL = 0.80
DEPLOY_ECE = 0.10
DEPLOY_ERROR_RATE = 0.01
DEPLOY_PARSE_FAILURES = 0
# When a caveat about a small or unclear result applies.
WIDE_INTERVAL = 0.10


def gates(summary: DataFrame, versus_base: DataFrame, versus_strong: DataFrame, base: str, n_records: Column) -> DataFrame:
    """One row per provider with every criterion as its own boolean.

    ``versus_base`` holds provider, auprc_lower and recall_delta; ``versus_strong`` holds
    provider, lower and upper of the AUPRC difference. A criterion without its
    comparison is NULL, not false.
    """
    staged = (n_records >= STAGE_MIN_RECORDS) & (F.col("provider") != base)
    known = F.col("auprc_lower").isNotNull()
    useful = (F.col("auprc_lower") > USEFUL_AUPRC_LOWER) | (
        F.col("recall_delta") * 100.0 >= USEFUL_RECALL_POINTS
    )
    joined = (
        summary.join(versus_base.select("provider", "auprc_lower", "recall_delta"), "provider", "left")
        .join(versus_strong.select("provider", "lower", "upper"), "provider", "left")
    )
    checked = joined.select(
        "provider",
        staged.alias("useful_reported"),
        F.when(staged & known, useful).alias("useful_passed"),
        (F.col("lower") > 0).alias("beats_strong"),
        (F.col("upper") < 0).alias("loses_to_strong"),
        (F.col("precision") >= DEPLOY_PRECISION).alias("precision_ok"),
        (F.col("recall") >= DEPLOY_RECALL).alias("recall_ok"),
        F.coalesce(F.col("ece") <= DEPLOY_ECE, F.lit(False)).alias("ece_ok"),
        (F.col("error_rate") < DEPLOY_ERROR_RATE).alias("error_rate_ok"),
        (F.col("parse_failure_count") <= DEPLOY_PARSE_FAILURES).alias("parse_failures_ok"),
    )
    every = F.lit(True)
    for c in ("precision_ok", "recall_ok", "ece_ok", "error_rate_ok", "parse_failures_ok"):
        every = every & F.col(c)
    return checked.withColumn("deployment_passed", every)


def with_verdict(intervals: DataFrame, ran: Column | None = None) -> DataFrame:
    return intervals.withColumn("verdict", verdict(F.col("lower"), F.col("upper"), F.lit(True) if ran is None else ran))


def claims(verdicts: DataFrame, prices: DataFrame) -> DataFrame:
    """Finding rows a verdict supports, and a caveat row for an arm without a price."""
    beat = verdicts.where(F.col("verdict").isin("wins", "loses", "no_difference")).select(
        "provider",
        F.concat_ws(" ", F.col("provider"), F.when(F.col("verdict") == "wins", "beats").when(F.col("verdict") == "loses", "trails").otherwise("is not told apart from"), F.col("rival")).alias("text"),
        F.when(F.col("verdict") == "wins", "for").when(F.col("verdict") == "loses", "against").otherwise("neutral").alias("stance"),
    )
    unpriced = prices.where(F.col("cost_per_1000_usd").isNull()).select(
        "provider", F.concat(F.col("provider"), F.lit(" has no price on record")).alias("text"), F.lit("caveat").alias("stance")
    )
    return beat.unionByName(unpriced)


def caveats(facts: DataFrame) -> DataFrame:
    """One row per caveat that applies to a comparison.

    ``facts`` holds provider, kind, lower, upper, truncated, n_traces and deviations.
    """
    width = F.col("upper") - F.col("lower")
    share = F.try_divide(F.col("truncated").cast("double"), F.col("n_traces").cast("double"))
    rules = [
        ("synthetic_data", "warning", F.col("kind") == "synthetic"),
        ("real_labels_from_ground_truth", "info", F.col("kind") == "real"),
        ("interval_not_computed", "warning", F.col("lower").isNull() | F.col("upper").isNull()),
        ("interval_crosses_zero", "warning", (F.col("lower") <= 0) & (F.col("upper") >= 0)),
        ("interval_wide", "info", width > WIDE_INTERVAL),
        ("traces_shortened", "warning", share > 0),
        ("request_parameters_dropped", "info", F.col("deviations") > 0),
    ]
    found = F.filter(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(name).alias("caveat"), F.lit(level).alias("severity")))
                for name, level, cond in rules
            ]
        ),
        lambda c: c.isNotNull(),
    )
    return facts.select("provider", F.explode(found).alias("c")).select("provider", "c.*")


def deferred(snapshot: DataFrame, comparison: DataFrame, key: str = "run_id") -> DataFrame:
    """A snapshot with its verdict, pending until the comparison has been written."""
    return snapshot.join(comparison.select(key, "verdict"), key, "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit("pending"))
    )
