"""Detection by fault group: lane rates, gaps, controls and headline counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import POSITIVE_LABEL, beside, ratio


def per_fault_matrix(scored: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    flagged = F.count(F.when(F.col("score") >= threshold, 1))
    return scored.groupBy(*keys, "label", "fault_type").agg(
        F.count(F.lit(1)).alias("n"),
        flagged.alias("flagged"),
        F.avg("score").alias("mean_score"),
        ratio(flagged, F.count(F.lit(1))).alias("flag_rate"),
    )


def fault_heatmap(matrix: DataFrame, providers: Sequence[str]) -> DataFrame:
    """(label/fault) rows by provider columns of flag rates."""
    return (
        matrix.groupBy(F.concat_ws("/", "label", "fault_type").alias("cell"))
        .pivot("provider", list(providers))
        .agg(F.max("flag_rate"))
    )


def lanes_by_trace(points: DataFrame, threshold: Column, providers: Sequence[str], free: Sequence[str]) -> DataFrame:
    """One row per trace with each lane's scored and flagged state and the free union.

    All lanes fold in one aggregate on the trace instead of one scan per lane and group.
    """
    scored = F.col("primary_score").isNotNull()
    hit = scored & (F.col("primary_score") >= threshold)
    of = lambda p: F.col("provider") == p
    bit = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    free_lane = F.col("provider").isin(*free)
    return points.groupBy("trace_id").agg(
        *[bit(of(p) & scored).alias(f"{p}_scored") for p in providers],
        *[bit(of(p) & hit).alias(f"{p}_flagged") for p in providers],
        bit(free_lane & scored).alias("free_union_scored"),
        bit(free_lane & hit).alias("free_union_flagged"),
    )


def lane_table(truth: DataFrame, lanes: DataFrame) -> DataFrame:
    return truth.select("trace_id", "label", "fault_type").join(lanes, "trace_id", "left")


def lane_aggregates(names: Sequence[str]) -> list[Column]:
    out = []
    for p in names:
        scored, hit = F.col(f"{p}_scored"), F.col(f"{p}_flagged") & F.col(f"{p}_scored")
        out += [
            F.count(F.when(hit, 1)).alias(f"{p}_flagged"),
            F.count(F.when(scored, 1)).alias(f"{p}_scored"),
            ratio(F.count(F.when(hit, 1)), F.count(F.when(scored, 1))).alias(f"{p}_rate"),
        ]
    return out


def cell_rates(table: DataFrame, providers: Sequence[str], lane: str, rivals: Sequence[str]) -> DataFrame:
    """Rates of every lane per (label, fault), with the gap of one lane to its rivals."""
    names = [*providers, "free_union"]
    cells = table.groupBy("label", "fault_type").agg(F.count(F.lit(1)).alias("n"), *lane_aggregates(names))
    gaps = {f"gap_vs_{r}": F.col(f"{lane}_rate") - F.col(f"{r}_rate") for r in rivals}
    return cells.withColumns(gaps)


def detection_groups(
    table: DataFrame, points: DataFrame, providers: Sequence[str], lane: str, rivals: Sequence[str]
) -> DataFrame:
    """The positive cells, with what the metered lane spent and waited on each."""
    positive = table.where(F.col("label") == POSITIVE_LABEL)
    mine = points.where(F.col("provider") == lane).join(
        positive.select("trace_id", "fault_type"), "trace_id", "inner"
    )
    spend = mine.groupBy("fault_type").agg(
        F.sum("cost_usd").alias("_cost"), F.avg("latency_ms").alias("mean_latency_ms")
    )
    groups = cell_rates(positive, providers, lane, rivals).drop("label")
    return groups.join(spend, "fault_type", "left").withColumn(
        "cost_usd", F.coalesce("_cost", F.lit(0.0))
    ).drop("_cost")


def no_added_value(groups: DataFrame, free: Sequence[str], strong: str) -> DataFrame:
    """Groups where a free lane already catches all, or the metered lane is no better."""
    caught = F.lit(False)
    for p in free:
        caught = caught | ((F.col(f"{p}_rate") == 1.0) & (F.col(f"{p}_scored") > 0))
    no_better = (F.col(f"gap_vs_{strong}") <= 0) & (F.col(f"{strong}_scored") > 0)
    return groups.where(F.coalesce(caught, F.lit(False)) | F.coalesce(no_better, F.lit(False)))


def control_separation(scored: DataFrame, keys: Sequence[str], threshold: Column, fault: str, control: str) -> DataFrame:
    """Flag rate on a fault less the flag rate on its matched control."""
    hit = F.col("score") >= threshold

    def rate(name: str) -> Column:
        mine = F.col("fault_type") == name
        return ratio(F.count(F.when(mine & hit, 1)), F.count(F.when(mine, 1)))

    return scored.groupBy(*keys).agg(
        F.count(F.when(F.col("fault_type") == fault, 1)).alias("fault_n"),
        F.count(F.when(F.col("fault_type") == control, 1)).alias("control_n"),
        rate(fault).alias("fault_rate"),
        rate(control).alias("control_rate"),
        (rate(fault) - rate(control)).alias("separation"),
    )


def lane_summary(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Flagged, scored and rate of each lane over the positives; a rate over nothing is NULL."""
    wide = table.where(F.col("label") == POSITIVE_LABEL).agg(*lane_aggregates(names))
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("lane"),
                    F.col(f"{p}_flagged").alias("flagged"),
                    F.col(f"{p}_scored").alias("scored"),
                    F.col(f"{p}_rate").alias("rate"),
                )
                for p in names
            ]
        )
    ).alias("e")
    return wide.select(each).select("e.*")


def kpis(table: DataFrame, predictions: DataFrame, lane: str, rules: str, strong: str, free: Sequence[str]) -> DataFrame:
    """One row of headline counts, all from one pass over the lane table."""
    pos = F.col("label") == POSITIVE_LABEL
    flag = lambda p: F.coalesce(F.col(f"{p}_flagged"), F.lit(False))
    seen = lambda p: F.coalesce(F.col(f"{p}_scored"), F.lit(False))
    missed = lambda p: seen(p) & ~flag(p)
    none = ~flag("free_union")
    count = lambda cond: F.count(F.when(pos & cond, 1))
    counts = table.agg(
        F.count(F.lit(1)).alias("traces_total"),
        F.count(F.when(pos, 1)).alias("positives_total"),
        count(flag(lane)).alias("caught_with"),
        count(seen(lane)).alias("caught_with_scored"),
        count(flag(rules)).alias("caught_rules"),
        count(flag(strong)).alias("caught_strong"),
        count(flag("free_union")).alias("caught_free_union"),
        count(missed(rules) & flag(lane)).alias("only_vs_rules"),
        count(missed(strong) & flag(lane)).alias("only_vs_strong"),
        count(none & flag(lane)).alias("only_vs_union"),
        count(missed(rules)).alias("rules_misses"),
        count(missed(strong)).alias("strong_misses"),
        count(none).alias("union_misses"),
    )
    mine = predictions.where(F.col("provider") == lane)
    # Distinct traces first fold by trace, so the one-row total adds small counts.
    spent = (
        mine.groupBy("trace_id")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("cost_usd").alias("c"))
        .agg(
            F.count(F.lit(1)).alias("traces_evaluated"),
            F.sum("k").alias("predictions_written"),
            F.sum("c").alias("spend_usd"),
        )
    )
    return beside(counts, spent)
