"""Operational rollups: latency, errors, tokens, cost, repeats, label shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import cost_usd, parse_utc
from ..schemas import LABELS, ratio, ratio0
from .quantiles import quantiles

# The quantiles of every latency panel.
QUANTILES = (0.50, 0.95, 0.99)


def with_cost(priced: DataFrame) -> DataFrame:
    """Recompute every cost from the joined rates."""
    return priced.withColumn(
        "cost_usd",
        cost_usd(*[F.col(c) for c in ("input_tokens", "output_tokens", "in_rate", "out_rate", "verified")]),
    ).drop("in_rate", "out_rate", "verified")


def is_parse_failure() -> Column:
    return F.contains(F.col("error"), F.lit("ParseFailure"))


QUANTILE_NAMES = ("p50_ms", "p95_ms", "p99_ms")


def with_quantiles(rows: DataFrame, keys: Sequence[str], approximate: bool) -> DataFrame:
    """Quantiles of ``latency_ms`` with its ``total`` and ``sum``: exact ones by rank cells, approximate ones by a bounded sketch."""
    if not approximate:
        return quantiles(rows, keys, "latency_ms", QUANTILES, QUANTILE_NAMES)
    named = [F.percentile_approx("latency_ms", q, 10_000).alias(n) for q, n in zip(QUANTILES, QUANTILE_NAMES, strict=True)]
    return rows.groupBy(*keys).agg(*named, F.count("latency_ms").alias("total"), F.sum("latency_ms").alias("sum"))


def latency_summary(predictions: DataFrame, keys: Sequence[str], approximate: bool = False) -> DataFrame:
    """Positive latencies only."""
    rows = with_quantiles(predictions.where("latency_ms > 0"), keys, approximate)
    return rows.select(
        *keys,
        *QUANTILE_NAMES,
        (F.col("sum") / F.col("total")).alias("mean_ms"),
        (F.col("sum") / 1e3).alias("total_s"),
        F.try_divide(F.col("total").cast("double"), F.col("sum") / 1e3).alias("throughput_per_s"),
    )


def operational_columns() -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("n_predictions"),
        F.count("error").alias("error_count"),
        ratio0(F.count("error"), n).alias("error_rate"),
        F.count(F.when(is_parse_failure(), 1)).alias("parse_failure_count"),
        F.sum(F.greatest(F.lit(0), F.col("n_attempts") - 1)).cast("bigint").alias("retry_count"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
    ]


def operational_summary(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost is summed over the priced rows; unpriced rows are counted beside it."""
    return priced.groupBy(*keys).agg(
        *operational_columns(),
        F.sum("cost_usd").alias("total_cost_usd"),
        (F.count(F.lit(1)) - F.count("cost_usd")).alias("cost_unpriced_predictions"),
    )


def run_manifest(priced: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per-run rollup; the total cost exists only when every row is priced."""
    return priced.groupBy(*keys).agg(
        *operational_columns(),
        F.when(F.count("cost_usd") == F.count(F.lit(1)), F.sum("cost_usd")).alias("total_cost_usd"),
    )


def cost_per_1000(priced: DataFrame, keys: Sequence[str], fx_rate: float) -> DataFrame:
    mean = F.avg("cost_usd") * 1000.0
    return priced.groupBy(*keys).agg(
        mean.alias("cost_per_1000_usd"), (mean * F.lit(float(fx_rate))).alias("cost_per_1000_converted")
    )


def repeat_stability(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Modal label share and score variance over repeats, averaged over traces.

    The label counts ride in the same aggregate as conditional counts, so each trace
    is folded once.
    """
    counts = [F.count(F.when(F.col("predicted_label") == name, 1)) for name in LABELS]
    per = predictions.groupBy(*keys, "trace_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.greatest(*counts).alias("modal"),
        F.count("predicted_label").alias("labelled"),
        F.count("primary_score").alias("scores"),
        F.var_pop("primary_score").alias("spread"),
    )
    many = F.col("size") >= 2
    return per.groupBy(*keys).agg(
        F.max("size").alias("max_repeats"),
        F.avg(F.when(many & (F.col("labelled") > 0), ratio(F.col("modal"), F.col("labelled")))).alias("mean_label_agreement"),
        F.avg(F.when(many & (F.col("scores") >= 2), F.col("spread"))).alias("mean_score_variance"),
    )


def zero_filled(counts: list[tuple[str, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("n")) for k, v in counts]))


def prevalence(truth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each label, zero-filled, in one aggregate."""
    counts = truth.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("label") == name, 1)).alias(name) for name in LABELS],
    )
    long = counts.select(*keys, "total", zero_filled([(n, F.col(n)) for n in LABELS]).alias("c"))
    return long.select(
        *keys, "c.label", "c.n", (F.col("c.n").cast("double") / F.greatest(F.col("total"), F.lit(1))).alias("share")
    )


def label_fault_counts(truth: DataFrame) -> DataFrame:
    faults = truth.groupBy(F.lit("fault").alias("kind"), F.col("fault_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    labels = prevalence(truth).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    return faults.unionByName(labels)


def cost_block(priced: DataFrame, runs: DataFrame, fx_rate: float) -> DataFrame:
    """Spend of each run and of its siblings on the same (provider, split)."""
    per_run = priced.groupBy("run_id").agg(
        F.sum("cost_usd").alias("_sum"),
        F.count("cost_usd").alias("n_priced"),
        F.count(F.lit(1)).alias("n_all"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    block = runs.select("run_id", "provider", "split").join(per_run, "run_id", "inner").withColumns(
        {
            "spend_usd": F.coalesce("_sum", F.lit(0.0)),
            "complete_usd": F.when(F.col("n_priced") == F.col("n_all"), F.col("_sum")),
        }
    )
    # A sibling counts only when its own total exists, that is when all its rows are priced.
    sweep = block.groupBy("provider", "split").agg(
        F.sum("complete_usd").alias("sibling_usd"),
        F.sum(F.when(F.col("complete_usd").isNotNull(), F.col("n_all"))).alias("sibling_requests"),
    )
    own = F.coalesce(F.col("complete_usd"), F.lit(0.0))
    own_n = F.when(F.col("complete_usd").isNotNull(), F.col("n_all")).otherwise(0)
    per_request = ratio(F.col("spend_usd"), F.col("n_priced"))
    sweep_usd = F.coalesce("sibling_usd", F.lit(0.0)) - own + F.col("spend_usd")
    return block.join(sweep, ["provider", "split"], "inner").select(
        "run_id",
        "provider",
        "split",
        "spend_usd",
        (F.col("spend_usd") * F.lit(float(fx_rate))).alias("spend_converted"),
        sweep_usd.alias("sweep_spend_usd"),
        (F.coalesce("sibling_requests", F.lit(0)) - own_n + F.col("n_priced")).alias("sweep_requests"),
        "n_priced",
        (F.col("n_all") - F.col("n_priced")).alias("n_unpriced"),
        per_request.alias("cost_per_request_usd"),
        (per_request * 1000.0).alias("cost_per_1000_usd"),
        "input_tokens",
        "output_tokens",
    )


def speed_by_arm(predictions: DataFrame, runs: DataFrame, approximate: bool = False) -> DataFrame:
    """Per run: latency quantiles with zeros included; throughput of complete runs only."""
    counts = predictions.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    per_run = counts.join(with_quantiles(predictions, ["run_id"], approximate), "run_id", "left").withColumn("mean_ms", F.col("sum") / F.col("total"))
    seconds = (
        parse_utc(F.col("updated_utc")).cast("double") - parse_utc(F.col("created_utc")).cast("double")
    )
    zero = F.lit(0.0)
    joined = runs.withColumn(
        "wall_s", F.when((F.col("status") == "complete") & (seconds > 0), seconds)
    ).join(per_run, "run_id", "left")
    return joined.select(
        "run_id",
        "provider",
        "concurrency",
        "status",
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(c, zero).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms", "mean_ms")],
        "wall_s",
        ratio(F.coalesce("n", F.lit(0)), F.col("wall_s")).alias("throughput_per_s"),
    )
