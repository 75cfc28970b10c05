"""Set checks between splits, units, faults and labels, as rows of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import IntegrityError, refuse_if_any


def split_overlap(split_unit: DataFrame) -> DataFrame:
    """Units that appear in more than one split."""
    return (
        split_unit.groupBy("template_family")
        .agg(F.array_sort(F.collect_set("split")).alias("splits"))
        .where(F.size("splits") > 1)
        .select("template_family", F.concat_ws(",", "splits").alias("splits"))
    )


def uncovered_units(truth: DataFrame, split_unit: DataFrame) -> DataFrame:
    return truth.select("template_family").distinct().join(
        split_unit.select("template_family"), "template_family", "left_anti"
    )


def fault_gaps(truth: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected faults never seen, and seen faults not expected."""
    seen = truth.select(F.col("fault_type").alias("fault")).distinct()
    wanted = truth.sparkSession.createDataFrame([(f,) for f in expected], "fault string")
    missing = wanted.join(seen, "fault", "left_anti").select(F.lit("missing").alias("problem"), "fault")
    foreign = seen.where(~F.col("fault").isin(*expected)).select(F.lit("foreign").alias("problem"), "fault")
    return missing.unionByName(foreign)


def held_out_in_fit(fit_rows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Units of the fitting rows that are held out; must be empty."""
    return fit_rows.select("template_family").distinct().join(held_out, "template_family", "left_semi")


def unseen_labels(validation: DataFrame, training: DataFrame) -> DataFrame:
    return validation.select("label").distinct().join(training.select("label").distinct(), "label", "left_anti")


def fit_guard(training: DataFrame, validation: DataFrame, held_out: DataFrame) -> None:
    """Refuse a fit that touches held-out units, lacks rows, or calibrates unseen labels."""
    refuse_if_any(held_out_in_fit(training.select("template_family").union(validation.select("template_family")), held_out), "held-out unit reached fit")
    if training.isEmpty() or validation.isEmpty():
        raise IntegrityError("both a training and a validation set are required")
    refuse_if_any(unseen_labels(validation, training), "validation labels missing from training")


def select_split(traces: DataFrame, split_unit: DataFrame, split: str) -> DataFrame:
    units = split_unit.where(F.col("split") == split).select("template_family")
    return traces.join(units, "template_family", "left_semi")


def label_diversity(truth: DataFrame) -> DataFrame:
    """Units whose traces all carry one label. Folded twice so no unit is held whole."""
    return (
        truth.groupBy("template_family")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where(F.col("low") == F.col("high"))
        .select("template_family", F.col("low").alias("label"))
    )


def duplicate_ids(truth: DataFrame) -> DataFrame:
    return truth.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def allow_list(found: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows under an allowed directory; refuses when none is."""
    kept = found.where(F.col(column).isin(*allowed))
    if kept.isEmpty():
        names = [r[0] for r in found.select(column).distinct().limit(20).collect()]
        raise IntegrityError(f"none of {list(allowed)} found; saw {sorted(names)}")
    return kept
