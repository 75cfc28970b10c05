"""Table schemas and the small fixed dimensions every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Names, order and sets that results depend on.
LABELS = (
    "supported_success",
    "unsupported_success",
    "reported_failure_or_uncertainty",
    "no_success_claim",
)
POSITIVE_LABEL = "unsupported_success"
EVENT_TYPES = ("assistant_tool_call", "tool_result", "assistant_message")
DECISIONS = ("flag", "pass", "error", "not_run")
SYNTHETIC_FAULTS = (
    "none",
    "explicit_error",
    "timeout_null_result",
    "wrong_entity",
    "wrong_parameter",
    "stale_evidence",
    "attempt_without_confirmation",
    "irrelevant_success",
    "valid_retry_recovery",
    "noop_positive",
    "semantic_target_mismatch",
    "semantic_target_match",
)
REAL_FAULTS = (
    "real_unsupported_completion_easy",
    "real_unsupported_completion_medium",
    "real_unsupported_completion_hard",
    "real_supported_completion",
    "real_reported_failure",
    "real_no_completion_claim",
)
TRUTH_FIELDS = ("label", "fault_type", "oracle")

EVENT = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
TOOL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("required", T.ArrayType(T.StringType())),
    ]
)
TRACE = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("template_family", T.StringType()),
        T.StructField("goal", T.StringType()),
        T.StructField("tool_schema", T.ArrayType(TOOL)),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("label", T.StringType()),
        T.StructField("fault_type", T.StringType()),
        T.StructField("oracle", T.StringType()),
    ]
)
ATTEMPT = T.StructType(
    [
        T.StructField("attempt_number", T.IntegerType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("retry_delay_seconds", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)
PREDICTION = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("repeat_no", T.IntegerType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("primary_score", T.DoubleType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("has_success_claim", T.DoubleType()),
        T.StructField("tool_evidence_supports_claim", T.DoubleType()),
        T.StructField("needs_review", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("attempts", T.ArrayType(ATTEMPT)),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)
TRUNCATION = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("original_events", T.IntegerType()),
        T.StructField("kept_events", T.IntegerType()),
        T.StructField("dropped_events", T.IntegerType()),
        T.StructField("original_state_chars", T.LongType()),
        T.StructField("final_state_chars", T.LongType()),
        T.StructField("budget_chars", T.LongType()),
        T.StructField("shortened_payloads", T.IntegerType()),
        T.StructField("fits", T.BooleanType()),
    ]
)
DEVIATION = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("requested", T.StringType()),
        T.StructField("applied", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("first_seen_trace_id", T.StringType()),
        T.StructField("occurrences", T.LongType()),
    ]
)


class IntegrityError(RuntimeError):
    """A refusal: the data breaks a rule that a metric depends on."""


def refuse_if_any(violations: DataFrame, message: str, show: int = 3) -> None:
    """Raise when a violation table has a row; only a few rows reach the driver."""
    rows = violations.limit(show).collect()
    if rows:
        raise IntegrityError(f"{message}: {[tuple(r) for r in rows]}")


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, i, name == POSITIVE_LABEL) for i, name in enumerate(LABELS)],
        "label string, ord int, is_positive boolean",
    )


def beside(rows: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the columns of one-row tables as scalar subqueries, so no join is planned."""
    for table in one_row:
        value = table.select(F.struct("*").alias("_row")).scalar()
        rows = rows.withColumn("_row", value).select("*", "_row.*").drop("_row")
    return rows


def is_positive(label: str | Column = "label") -> Column:
    return F.when((F.col(label) if isinstance(label, str) else label) == POSITIVE_LABEL, 1).otherwise(0)


def ratio(top: Column, bottom: Column) -> Column:
    """top/bottom as DOUBLE, NULL over nothing."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio0(top: Column, bottom: Column) -> Column:
    """top/bottom as DOUBLE, 0.0 over nothing."""
    return F.coalesce(ratio(top, bottom), F.lit(0.0))
