"""Labels from recorded ground truth, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import LABELS, refuse_if_any
from .text import strip

# Claim words and the fault names of a labelled row.
CLAIM_SUCCESS = ("success", "succeeded", "complete", "completed")
CLAIM_FAILURE = ("fail", "failure", "failed", "error", "incomplete")
FAULT_BY_DIFFICULTY = {
    1: "real_unsupported_completion_easy",
    2: "real_unsupported_completion_medium",
    3: "real_unsupported_completion_hard",
}
OTHER_DIFFICULTY = "real_unsupported_completion_medium"
FAULT_BY_LABEL = {
    "supported_success": "real_supported_completion",
    "reported_failure_or_uncertainty": "real_reported_failure",
    "no_success_claim": "real_no_completion_claim",
}
UNKNOWN_CLAIM = "unrecognised"


def normalise_claim(status: Column) -> Column:
    """success, failure, NULL for none, or ``unrecognised`` for a word outside the rule."""
    word = F.lower(strip(status))
    return (
        F.when(status.isNull() | (word == ""), F.lit(None).cast("string"))
        .when(word.isin(*CLAIM_SUCCESS), "success")
        .when(word.isin(*CLAIM_FAILURE), "failure")
        .otherwise(UNKNOWN_CLAIM)
    )


def refuse_unknown_claims(rows: DataFrame, claim: str = "claim") -> None:
    refuse_if_any(rows.where(F.col(claim) == UNKNOWN_CLAIM), "completion status outside the label rule")


def label_for(claim: Column, truth: Column) -> Column:
    """NULL for a success claim without truth; such rows are dropped and counted."""
    return (
        F.when(claim.isNull(), LABELS[3])
        .when(claim == "failure", LABELS[2])
        .when((claim == "success") & truth, LABELS[0])
        .when((claim == "success") & ~truth, LABELS[1])
    )


def fault_for(label: Column, difficulty: Column) -> Column:
    hard = F.lit(OTHER_DIFFICULTY)
    for level, name in FAULT_BY_DIFFICULTY.items():
        hard = F.when(difficulty == level, name).otherwise(hard)
    out = F.when(label == LABELS[1], hard)
    for name, fault in FAULT_BY_LABEL.items():
        out = out.when(label == name, fault)
    return out


def drop_reason(goal: Column, claim: Column, truth: Column) -> Column:
    """Why a source row is not kept, NULL when it is."""
    return F.when(F.coalesce(goal, F.lit("")) == "", "no_goal").when(
        (claim == "success") & truth.isNull(), "no_ground_truth"
    )


def ingest_counts(rows: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Seen, kept and dropped counts in one row."""
    why = F.col(reason)
    return rows.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count(F.when(why.isNull(), 1)).alias("kept"),
        F.count(F.when(why == "no_goal", 1)).alias("dropped_no_goal"),
        F.count(F.when(why == "no_ground_truth", 1)).alias("dropped_no_ground_truth"),
    )
