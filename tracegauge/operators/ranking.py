"""Ranking metrics from a table of distinct scores, exact under ties.

Every metric of an arm follows from (score, rows, positives) in descending order and
the totals before each score. An arm is a group column, never a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ratio, ratio0
from .running import running_totals, score_cells

# Review budgets and default prevalences.
BUDGETS = (0.01, 0.05, 0.10, 0.20)
PREVALENCES = (0.01, 0.05, 0.10)


def score_groups(scored: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """One row per (keys, distinct score) with row and positive counts."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos")
    )


def ranked_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct scores with counts before each, best score first."""
    return running_totals(groups, keys, ["score"], ["n", "pos"], score_cells(), descending=True)


def budget_size(budget: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(budget * total.cast("double"))).cast("bigint")


def recall_share(budget: Column) -> Column:
    """This score's part of the recall reached by reviewing the top ``budget`` share.

    A score that straddles the cut gives the expected part of its positives.
    """
    k = budget_size(budget, F.col("total_n"))
    room = F.least(F.greatest(k - F.col("before_n"), F.lit(0)), F.col("n"))
    return F.when(
        room > 0,
        F.col("pos").cast("double") * (room.cast("double") / F.col("n").cast("double")),
    ).otherwise(0.0)


def both_classes() -> Column:
    return (F.sum("pos") > 0) & (F.sum("pos") < F.sum("n"))


def auprc_of() -> Column:
    """Average precision over distinct scores; NULL when only one class is present."""
    seen = (F.col("before_n") + F.col("n")).cast("double")
    hits = (F.col("before_pos") + F.col("pos")).cast("double")
    area = F.sum(F.col("pos").cast("double") * (hits / seen))
    return F.when(both_classes(), F.try_divide(area, F.sum("pos").cast("double")))


def auroc_of() -> Column:
    """Share of (positive, negative) pairs ranked right, a tie counting half."""
    neg = (F.col("n") - F.col("pos")).cast("double")
    neg_above = (F.col("before_n") - F.col("before_pos")).cast("double")
    lost = F.sum(F.col("pos").cast("double") * (neg_above + 0.5 * neg))
    pairs = F.sum("pos").cast("double") * F.sum(neg)
    return F.when(both_classes(), F.lit(1.0) - F.try_divide(lost, pairs))


def recall_at_of(budget: float) -> Column:
    k = budget_size(F.lit(float(budget)), F.max("total_n"))
    got = F.sum(recall_share(F.lit(float(budget))))
    return F.when(F.max("total_pos") > 0, F.when(k >= F.max("total_n"), 1.0).otherwise(ratio(got, F.max("total_pos"))))


METRICS = {
    "auprc": lambda **_: auprc_of(),
    "auroc": lambda **_: auroc_of(),
    "recall_at_budget": lambda budget=0.05, **_: recall_at_of(budget),
}


def metric_by_name(name: str, **options) -> Column:
    """The grouped-metric builder for a name; an unknown name is refused."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name](**options)


def ranking_metrics(ranked: DataFrame, keys: Sequence[str], budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """AUPRC, AUROC and recall at each budget, one row per arm, in one aggregate."""
    return ranked.groupBy(*keys).agg(
        F.max("total_n").alias("n"),
        F.max("total_pos").alias("positives"),
        auprc_of().alias("auprc"),
        auroc_of().alias("auroc"),
        *[recall_at_of(b).alias(budget_name(b)) for b in budgets],
    )


def budget_name(budget: float) -> str:
    return f"recall_at_{round(budget * 100):d}"


def recall_at_budgets(ranked: DataFrame, keys: Sequence[str], budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """Long form: recall and the recall ceiling per arm and budget."""
    wide = ranked.groupBy(*keys).agg(
        F.max("total_n").alias("n"),
        F.max("total_pos").alias("positives"),
        *[recall_at_of(b).alias(budget_name(b)) for b in budgets],
    )
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(b)).alias("budget"),
                    F.col(budget_name(b)).alias("recall"),
                    recall_ceiling(F.lit(float(b)), F.col("n"), F.col("positives")).alias("ceiling"),
                )
                for b in budgets
            ]
        )
    ).alias("b")
    return wide.select(*keys, each).select(*keys, "b.*")


def recall_ceiling(budget: Column, n: Column, positives: Column) -> Column:
    k = budget_size(budget, n).cast("double")
    return F.when((n > 0) & (positives > 0), F.least(F.lit(1.0), k / positives.cast("double")))


def pr_curve(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall at every distinct score, with the prevalence line."""
    tp = F.col("before_pos") + F.col("pos")
    seen = F.col("before_n") + F.col("n")
    return ranked.select(
        *keys,
        "score",
        ratio(tp, seen).alias("precision"),
        ratio(tp, F.col("total_pos")).alias("recall"),
        ratio(F.col("total_pos"), F.col("total_n")).alias("prevalence"),
    )


def confusion(scored: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """Counts and rates at a threshold; a rate over nothing is 0.0 here."""
    flag = F.col("score") >= threshold
    pos = F.col("y") == 1
    count = lambda cond: F.count(F.when(cond, 1))
    counts = scored.groupBy(*keys).agg(
        count(flag & pos).alias("tp"),
        count(flag & ~pos).alias("fp"),
        count(~flag & pos).alias("fn"),
        count(~flag & ~pos).alias("tn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio0(tp, tp + fp),
            "recall": ratio0(tp, tp + fn),
            "fpr": ratio0(fp, fp + tn),
        }
    ).withColumn(
        "f1", ratio0(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def confusion_grid(scored: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts at every threshold of a grid, in one scan of the scores."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    folded = score_groups(scored, keys).withColumn("threshold", grid)
    flag = F.col("score") >= F.col("threshold")
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    part = lambda cond, what: F.sum(F.when(cond, what).otherwise(0))
    return with_rates(
        folded.groupBy(*keys, "threshold").agg(
            part(flag, pos).alias("tp"),
            part(flag, neg).alias("fp"),
            part(~flag, pos).alias("fn"),
            part(~flag, neg).alias("tn"),
        )
    )


def prior_shift(counts: DataFrame, keys: Sequence[str], prevalences: Sequence[float] = PREVALENCES) -> DataFrame:
    """Precision projected to other prevalences from the observed recall and fpr."""
    pi = F.col("prevalence")
    hit = pi * F.col("recall")
    total = hit + (F.lit(1.0) - pi) * F.col("fpr")
    return counts.withColumn(
        "prevalence", F.explode(F.array(*[F.lit(float(p)) for p in prevalences]))
    ).select(
        *keys,
        "prevalence",
        F.when(total > 0, hit / total).alias("projected_precision"),
        (F.col("fpr") == 0).alias("degenerate"),
    )


def top_budget_review(ranked: DataFrame, scored: DataFrame, keys: Sequence[str], budget: float) -> DataFrame:
    """The rows a reviewer would see, with the share of a tie that fits at the cut."""
    k = budget_size(F.lit(float(budget)), F.col("total_n"))
    chosen = ranked.where(F.col("before_n") < k).select(
        *keys,
        "score",
        (F.col("before_n") + 1).alias("rank"),
        (F.least(k - F.col("before_n"), F.col("n")).cast("double") / F.col("n")).alias("tie_share"),
    )
    return scored.join(chosen, [*keys, "score"], "inner")
