"""Joining predictions to truth, arms to arms, and lanes to each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import beside, is_positive, refuse_if_any
from ..session import settle


def unmatched_predictions(points: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions whose trace is not in the data set; must be empty before scoring."""
    return points.join(truth.select("trace_id"), "trace_id", "left_anti")


def point_predictions(
    predictions: DataFrame,
    keys: Sequence[str] = ("provider",),
    arrival: str = "arrival",
) -> DataFrame:
    """One prediction per (keys, trace): repeat 0, the last written.

    Only where an arm has no repeat 0 at all does the first arrival per trace stand in.
    One ordering says both: repeat 0 before the rest, then late before early for repeat 0
    and early before late for the others; so one aggregate, folded before the shuffle,
    picks the row, and the arm-wide rule is read off what was picked.
    """
    keys = list(keys)
    rest = [c for c in predictions.columns if c not in (*keys, "trace_id")]
    zero = F.col("repeat_no") == 0
    first = F.struct(zero.alias("z"), F.when(zero, F.col(arrival)).otherwise(-F.col(arrival)).alias("a"))
    picked = predictions.groupBy(*keys, "trace_id").agg(
        F.max_by(F.struct(*rest), first).alias("row"), F.bool_or(zero).alias("_zero")
    )
    # One row an arm: dealt by arm, the points of one would meet in one task.
    arms = F.broadcast(predictions.groupBy(*keys).agg(F.bool_or(zero).alias("_arm_zero")))
    return (
        picked.join(arms, keys, "inner")
        .where(F.col("_zero") | ~F.col("_arm_zero"))
        .select(*keys, "trace_id", "row.*")
    )


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("primary_score").isNotNull())


def score_join(points: DataFrame, truth: DataFrame) -> DataFrame:
    """Inner join to truth, refusing when any prediction has no truth row.

    The joined rows are settled: the refusal and every metric that follows read them, and
    the predictions are folded to points once only.
    """
    known = truth.drop(*[c for c in truth.columns if c != "trace_id" and c in points.columns]).withColumn("_known", F.lit(True))
    joined = settle(points.join(known, "trace_id", "left"), "scored")
    refuse_if_any(joined.where("_known IS NULL").select("trace_id"), "predictions carry a trace_id that is not in the data set")
    return (
        usable(joined.where("_known").drop("_known"))
        .withColumn("y", is_positive())
        .withColumnRenamed("primary_score", "score")
    )


def threshold_of(thresholds: Mapping[str, float], default: float = 0.5, provider: str = "provider") -> Column:
    """Per-provider threshold from a small mapping, else the default."""
    out = F.lit(float(default))
    for name, value in thresholds.items():
        out = F.when(F.col(provider) == name, F.lit(float(value))).otherwise(out)
    return out


def pair_arms(scored: DataFrame, arm: str, rival: str, provider: str = "provider") -> DataFrame:
    """Full outer pairing of two arms on trace; one side NULL where an arm has a gap.

    Both arms are read in one scan and folded by one aggregate on the trace, which is
    the same shuffle a full outer join would need for each side.
    """
    return (
        scored.where(F.col(provider).isin(arm, rival))
        .groupBy("trace_id")
        .agg(
            F.max("ord").alias("ord"),
            F.max("y").alias("y"),
            F.max(F.when(F.col(provider) == arm, F.col("score"))).alias("score_a"),
            F.max(F.when(F.col(provider) == rival, F.col("score"))).alias("score_b"),
        )
    )


def paired(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())


def unpaired(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("score_a").isNull() | F.col("score_b").isNull())


def arm_pairs(counts: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every arm against every comparison target that is present and different."""
    present = counts.select("provider")
    offered = present.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return offered.join(present.select(F.col("provider").alias("target")), "target", "left_semi").where(
        F.col("provider") != F.col("target")
    )


def price_join(predictions: DataFrame, prices: DataFrame, strict: bool = False) -> DataFrame:
    """Attach rates; strict mode refuses a model that has no price row."""
    rates = prices.select("model_id", "in_rate", "out_rate", "verified")
    if strict:
        refuse_if_any(
            unknown_models(predictions, prices),
            "no price row for a model",
        )
    return predictions.join(rates, "model_id", "left")


def unknown_models(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    return predictions.select("model_id").distinct().join(prices.select("model_id"), "model_id", "left_anti")


def public_rows(predictions: DataFrame, truth: DataFrame, threshold: Column) -> DataFrame:
    """The allow-listed columns of a prediction, with truth where it is known."""
    from ..functions.scores import decision

    labels = truth.select("trace_id", "label", "fault_type", "domain")
    return predictions.join(labels, "trace_id", "left").select(
        "trace_id",
        "repeat_no",
        "provider",
        "model_id",
        F.col("primary_score").alias("score"),
        decision(F.col("primary_score"), threshold, F.col("error")).alias("decision"),
        "predicted_label",
        "needs_review",
        "latency_ms",
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        "cost_usd",
        "error",
        "label",
        "fault_type",
        "domain",
    )


# -- lanes -----------------------------------------------------------------


def lane_flags(points: DataFrame, threshold: Column, provider: str = "provider") -> DataFrame:
    """(provider, trace) -> scored and flagged at the lane's own threshold."""
    return points.select(
        F.col(provider).alias("provider"),
        "trace_id",
        F.col("primary_score").isNotNull().alias("is_scored"),
        F.coalesce(F.col("primary_score") >= threshold, F.lit(False)).alias("flagged"),
    )


def any_lane(flags: DataFrame, lanes: Sequence[str]) -> DataFrame:
    """Union of lanes per trace: scored if any is scored, flagged if any scored lane flags."""
    return (
        flags.where(F.col("provider").isin(*lanes))
        .groupBy("trace_id")
        .agg(F.bool_or("is_scored").alias("is_scored"), F.bool_or("flagged").alias("flagged"))
    )


def missed_by_lane(positives: DataFrame, flags: DataFrame, lane: str) -> DataFrame:
    """Positives a lane scored below its threshold."""
    below = flags.where((F.col("provider") == lane) & F.col("is_scored") & ~F.col("flagged"))
    return positives.join(below.select("trace_id"), "trace_id", "left_semi")


def missed_by_all(positives: DataFrame, flags: DataFrame, lanes: Sequence[str]) -> DataFrame:
    """Positives no lane flags; an unscored lane does not flag."""
    hit = flags.where(F.col("provider").isin(*lanes) & F.col("flagged")).select("trace_id")
    return positives.join(hit, "trace_id", "left_anti")


def flagged_only_by(missed: DataFrame, flags: DataFrame, lane: str) -> DataFrame:
    """Of the missed traces, how many the lane scored and flagged."""
    mine = flags.where((F.col("provider") == lane) & F.col("is_scored"))
    return missed.join(mine.select("trace_id", "flagged"), "trace_id", "inner").agg(
        F.count(F.when(F.col("flagged"), 1)).alias("flagged"), F.count(F.lit(1)).alias("scored")
    )


def job_grid(records: DataFrame, repeats: int) -> DataFrame:
    """Every record once per repeat."""
    return records.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def curve_vs_reference(curves: DataFrame, references: DataFrame) -> DataFrame:
    """Every curve row beside every reference that has a value.

    References are a handful of zero-shot arms; they are folded to one array and
    attached to each row, so no cross join is planned.
    """
    known = references.where(F.col("reference_auprc").isNotNull() & ~F.isnan("reference_auprc"))
    folded = known.agg(F.collect_list(F.struct("reference", "reference_auprc")).alias("refs"))
    return beside(curves, folded).withColumn("ref", F.explode("refs")).drop("refs").select("*", "ref.*").drop("ref")
