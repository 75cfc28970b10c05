"""Report tables: each section a DataFrame, figures in tidy long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import format_value, verdict
from ..schemas import beside
from ..session import settle
from . import calibration as C, faults as L, intervals as I, joins as J, operational as O, ranking as R

ARM = ["provider"]


def provider_order(order: Sequence[str]) -> Column:
    """Reading order of a provider, NULL for one outside the list."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(order):
        out = F.when(F.col("provider") == name, i).otherwise(out)
    return out


def figure_points(metrics: DataFrame, intervals: DataFrame, metric: str, order: Sequence[str]) -> DataFrame:
    """One point per provider with its interval: the fixed reading order first, any others after it by name."""
    spread = intervals.where(F.col("metric") == metric).select("provider", "lower", "upper")
    return (
        metrics.select("provider", F.col(metric).alias("y"), "n")
        .join(spread, "provider", "left")
        .withColumn("_known", provider_order(order))
        .withColumn("ord", F.coalesce("_known", F.lit(len(order) - 1) + F.dense_rank().over(W.partitionBy(F.col("_known").isNull()).orderBy("provider"))))
        .drop("_known")
    )


def figure_table(
    figure: str, points: DataFrame, series: str, x: str, y: str = "y", lower: str | None = "lower", upper: str | None = "upper", extras: Sequence[str] = ()
) -> DataFrame:
    """Tidy rows of a figure: the numbers and the same numbers as they are shown."""
    bound = lambda c: F.col(c) if c is not None else F.lit(None).cast("double")
    return points.select(
        F.lit(figure).alias("figure"),
        F.col(series).alias("series"),
        F.col(x).cast("string").alias("x"),
        F.col(y).alias("y"),
        bound(lower).alias("lower"),
        bound(upper).alias("upper"),
        format_value(F.col(y)).alias("shown"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in extras],
    )


def primary_metrics(scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """The main table: ranking, threshold rates, macro F1, Brier and calibration error."""
    bins = C.reliability_bins(scored, ARM)
    return (
        R.ranking_metrics(ranked, ARM)
        .join(R.confusion(scored, ARM, F.col("threshold")), ARM)
        .join(C.macro_f1(scored, ARM), ARM)
        .join(C.brier(scored, ARM), ARM)
        .join(C.ece(bins, ARM), ARM)
    )


def report_tables(
    predictions: DataFrame, truth: DataFrame, prices: DataFrame, threshold: Column, fault: str, control: str, fx_rate: float
) -> Mapping[str, DataFrame]:
    """Every section of the report as its own lazily planned table."""
    # Points are folded whole, so they take along only what a section of scored rows reads.
    points = J.point_predictions(predictions.select(*ARM, "trace_id", "repeat_no", "arrival", "ord", "primary_score", "predicted_label", "confidence"))
    # Nearly every section starts from the scored rows, so they are written once.
    scored = J.score_join(points, truth.select("trace_id", "label", "fault_type")).withColumn("threshold", threshold)
    ranked = R.ranked_groups(R.score_groups(scored, ARM), ARM)
    priced = O.with_cost(J.price_join(predictions, prices))
    at = R.confusion(scored, ARM, F.col("threshold"))
    return {
        "primary_metrics": primary_metrics(scored, ranked),
        "confusion": at,
        "budgets": R.recall_at_budgets(ranked, ARM),
        "calibration": C.reliability_bins(scored, ARM),
        "selective": C.selective_accuracy(scored, ARM),
        "operational": O.operational_summary(priced, ARM),
        "latency": O.latency_summary(predictions, ARM),
        "cost": O.cost_per_1000(priced, ARM, fx_rate),
        "stability": O.repeat_stability(predictions, ARM),
        "fault_rates": L.per_fault_matrix(scored, ARM, F.col("threshold")),
        "control_separation": L.control_separation(scored, ARM, F.col("threshold"), fault, control),
        "prior_shift": R.prior_shift(at, ARM),
        "prevalence": O.prevalence(truth),
    }


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")


def judge_block(
    scored: DataFrame, priced: DataFrame, arm: str, rival: str, arm_threshold: float, rival_threshold: float, fx_rate: float, budget: float = 0.05, **bootstrap
) -> DataFrame:
    """One arm against a rival on the traces both scored, as one row.

    The verdict is not_run without a rival row, not_computable without two pairs of
    both classes, else what the interval of the AUPRC difference allows.
    """
    pairs = settle(J.paired(J.pair_arms(scored, arm, rival)), "pairs")
    pos = F.col("y") == 1

    def at(side: str, threshold: float, name: str) -> list[Column]:
        flag = F.col(side) >= threshold
        hit = F.count(F.when(flag & pos, 1)).cast("double")
        return [
            F.coalesce(F.try_divide(hit, F.count(F.when(flag, 1)).cast("double")), F.lit(0.0)).alias(f"{name}_precision"),
            F.coalesce(F.try_divide(hit, F.count(F.when(pos, 1)).cast("double")), F.lit(0.0)).alias(f"{name}_recall"),
        ]

    counts = pairs.agg(
        F.count(F.lit(1)).alias("n_paired"), F.count(F.when(pos, 1)).alias("n_positives"),
        *at("score_a", arm_threshold, "arm"), *at("score_b", rival_threshold, "rival"),
    )
    ran = scored.where(F.col("provider") == rival).agg((F.count(F.lit(1)) > 0).alias("rival_ran"))
    values = I.point_values(pairs, [], ["score_a", "score_b"], ("auprc", "auroc"), budget)
    of = lambda side, m: F.max(F.when(F.col("arm") == side, F.col(m)))
    points = values.agg(
        of("score_a", "auprc").alias("arm_auprc"), of("score_b", "auprc").alias("rival_auprc"),
        of("score_a", "auroc").alias("arm_auroc"), of("score_b", "auroc").alias("rival_auroc"),
    )
    spread = I.paired_bootstrap(pairs, metrics=("auprc", "recall_at_budget"), budget=budget, **bootstrap)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    interval = spread.agg(
        pick("auprc", "point").alias("delta_auprc"), pick("auprc", "lower").alias("lower"), pick("auprc", "upper").alias("upper"),
        pick("recall_at_budget", "point").alias("delta_recall"), pick("recall_at_budget", "lower").alias("recall_lower"), pick("recall_at_budget", "upper").alias("recall_upper"),
    )
    mean = lambda p: F.avg(F.when(F.col("provider") == p, F.col("cost_usd"))) * 1000.0
    cost = priced.agg(mean(arm).alias("arm_cost_per_1000"), mean(rival).alias("rival_cost_per_1000"))
    row = beside(counts, ran, points, interval, cost)
    enough = (F.col("n_paired") >= 2) & (F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n_paired"))
    judged = verdict(F.when(enough, F.col("lower")), F.when(enough, F.col("upper")), F.col("rival_ran"))
    return row.select(
        F.lit(arm).alias("arm"), F.lit(rival).alias("rival"), "*", judged.alias("verdict"),
        (F.col("arm_cost_per_1000") * fx_rate).alias("arm_cost_per_1000_converted"),
    )
