"""Calibration and escalation metrics over rank slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import LABELS, ratio, ratio0
from .running import sliced_sums

# The escalation fractions.
FRACTIONS = (0.0, 0.05, 0.10, 0.20, 0.40)


def brier(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def bin_of(bins: int):
    """Bin of a 1-based rank when n rows are cut at truncated even steps."""
    return lambda rank, total: F.floor(
        (rank * F.lit(bins) - F.lit(1)).cast("double") / total.cast("double")
    ).cast("int")


def reliability_bins(scored: DataFrame, keys: Sequence[str], tie: str = "ord", bins: int = 10) -> DataFrame:
    """Equal-frequency bins: rows, mean score and observed rate of each."""
    rows = scored.select(*keys, "score", tie, F.col("y").cast("bigint").alias("y"), F.col("score").alias("s"))
    cut = sliced_sums(rows, keys, "score", tie, ["y", "s"], bin_of(bins))
    return cut.select(
        *keys,
        F.col("slice").alias("bin"),
        "n",
        ratio(F.col("s"), F.col("n")).alias("mean_score"),
        ratio(F.col("y"), F.col("n")).alias("observed_rate"),
        "total_n",
    )


def ece(bins_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("observed_rate") - F.col("mean_score"))
    return bins_table.groupBy(*keys).agg(
        F.sum(F.col("n").cast("double") / F.col("total_n") * gap).alias("ece")
    )


def macro_f1(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean F1 over the four labels; an absent label contributes 0."""
    parts = []
    for i, name in enumerate(LABELS):
        true, said = F.col("label") == name, F.coalesce(F.col("predicted_label"), F.lit("")) == name
        parts += [
            F.count(F.when(true & said, 1)).alias(f"tp{i}"),
            F.count(F.when(~true & said, 1)).alias(f"fp{i}"),
            F.count(F.when(true & ~said, 1)).alias(f"fn{i}"),
        ]
    counts = labelled.groupBy(*keys).agg(*parts)

    def f1(i: int) -> Column:
        return ratio0(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}"))

    total = f1(0)
    for i in range(1, len(LABELS)):
        total = total + f1(i)
    return counts.select(*keys, (total / float(len(LABELS))).alias("macro_f1"))


def selective_accuracy(
    labelled: DataFrame, keys: Sequence[str], tie: str = "ord", fractions: Sequence[float] = FRACTIONS
) -> DataFrame:
    """Accuracy on what is kept as the least confident rows are escalated."""
    rows = labelled.where(F.col("confidence").isNotNull()).select(
        *keys,
        "confidence",
        tie,
        F.when(F.col("label") == F.col("predicted_label"), 1).otherwise(0).cast("bigint").alias("correct"),
    )

    def passed(rank: Column, total: Column) -> Column:
        cut = F.lit(0)
        for f in fractions:
            drop = F.bround(F.lit(float(f)) * total.cast("double"), 0)
            cut = cut + F.when(rank.cast("double") > drop, 1).otherwise(0)
        return cut

    slices = sliced_sums(rows, keys, "confidence", tie, ["correct"], passed)
    kept = slices.withColumn(
        "escalated_fraction",
        F.explode(
            F.filter(
                F.transform(
                    F.array(*[F.lit(float(f)) for f in fractions]),
                    lambda f, i: F.struct(f.alias("f"), i.alias("i")),
                ),
                lambda e: e["i"] < F.col("slice"),
            )
        ),
    )
    return kept.groupBy(*keys, F.col("escalated_fraction.f").alias("escalated_fraction")).agg(
        F.sum("n").alias("kept"), ratio(F.sum("correct"), F.sum("n")).alias("accuracy")
    )
