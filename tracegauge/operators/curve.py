"""Label-budget curves: summaries, crossings, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scores import t_critical
from .joins import curve_vs_reference

CURVE_METRICS = ("auprc", "auroc", "recall", "precision", "f1")


def paid_rows(predictions: DataFrame, free: Sequence[str]) -> DataFrame:
    """Rows that may not appear in a curve: a metered provider, a cost, or tokens."""
    nonzero = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    return predictions.where(
        ~F.col("provider").isin(*free) | nonzero("cost_usd") | nonzero("input_tokens") | nonzero("output_tokens")
    )


def curve_summary(points: DataFrame, metric: str = "auprc", size: str = "n_train") -> DataFrame:
    """Per provider and size: mean over seeds with its Student-t interval."""
    v = F.when(~F.isnan(metric), F.col(metric))
    table = points.groupBy("provider", F.col(size).alias("size")).agg(
        F.floor(F.avg("n_train")).cast("int").alias("n_train"),
        F.first("n_calibration", ignorenulls=True).alias("n_calibration"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("_sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(v).alias("n"),
    )
    half = F.coalesce(t_critical(F.col("n") - 1) * F.col("_sd") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))
    return table.select(
        "provider",
        "n_train",
        "n_calibration",
        "mean",
        F.when(F.col("n") > 0, F.coalesce("_sd", F.lit(0.0))).alias("sd"),
        (F.col("mean") - half).alias("lower"),
        (F.col("mean") + half).alias("upper"),
        "min",
        "max",
        "n",
    )


def crossover(summary: DataFrame, references: DataFrame) -> DataFrame:
    """First size from which a curve stays above a reference, on its mean and lower bound."""
    rows = curve_vs_reference(summary, references)
    keys = ["provider", "reference"]
    onward = Window.partitionBy(*keys).orderBy("n_train").rowsBetween(0, Window.unboundedFollowing)
    # A missing value never counts as above, nor lets a smaller size count.
    above = lambda c: F.coalesce((F.col(c) > F.col("reference_auprc")) & ~F.isnan(c), F.lit(False))
    held = rows.withColumns(
        {
            "mean_holds": F.bool_and(above("mean")).over(onward),
            "lower_holds": F.bool_and(above("lower")).over(onward),
            "mean_above": above("mean"),
            "mean_below": F.coalesce((F.col("mean") < F.col("reference_auprc")) & ~F.isnan("mean"), F.lit(False)),
        }
    )
    out = held.groupBy(*keys, "reference_auprc").agg(
        F.min(F.when(F.col("mean_holds"), F.col("n_train"))).alias("mean_n"),
        F.min(F.when(F.col("lower_holds"), F.col("n_train"))).alias("lower_n"),
        F.min_by("mean", F.when(F.col("mean_holds"), F.col("n_train"))).alias("mean_value"),
        F.min("n_train").alias("smallest_n"),
        F.max("n_train").alias("largest_n"),
        F.min_by("mean_above", "n_train").alias("beats_at_smallest"),
        F.bool_or("mean_below").alias("reference_leads_anywhere"),
    )
    statement = (
        F.when(F.col("mean_n").isNull(), F.concat(F.col("provider"), F.lit(" never beats "), F.col("reference"), F.lit(" up to "), F.col("largest_n").cast("string"), F.lit(" labels")))
        .when(F.col("beats_at_smallest") & (F.col("mean_n") == F.col("smallest_n")), F.concat(F.col("provider"), F.lit(" beats "), F.col("reference"), F.lit(" at the smallest size, "), F.col("smallest_n").cast("string"), F.lit(" labels")))
        .otherwise(F.concat(F.col("provider"), F.lit(" needs about "), F.col("mean_n").cast("string"), F.lit(" labels to beat "), F.col("reference")))
    )
    return out.withColumn("margin", F.col("mean_value") - F.col("reference_auprc")).withColumn("statement", statement)


def crossover_markers(crossings: DataFrame) -> DataFrame:
    """Mean crossings grouped by label budget, with the lines that cross there."""
    return (
        crossings.where(F.col("mean_n").isNotNull())
        .groupBy(F.col("mean_n").alias("n_train"))
        .agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(">", "provider", "reference")))).alias("lines"))
    )


def size_spread(summary: DataFrame) -> DataFrame:
    """Each size with its gain over the size before it."""
    w = Window.partitionBy("provider").orderBy("n_train")
    return summary.select("provider", "n_train", "mean", (F.col("mean") - F.lag("mean").over(w)).alias("gain"))


def curve_rebuild(points: DataFrame, references: DataFrame, metric: str = "auprc") -> DataFrame:
    """Summaries and crossings again from stored points and the current references."""
    return crossover(curve_summary(points, metric), references)


def newest_curve(curves: DataFrame, split: str, dataset_id: str) -> DataFrame:
    """Points of the newest stored curve for a split and data set; stale ones are skipped."""
    fit = curves.where((F.col("split") == split) & (F.col("dataset_id") == dataset_id))
    newest = fit.agg(F.max("curve_id").alias("curve_id"))
    return fit.join(newest, "curve_id", "left_semi")
