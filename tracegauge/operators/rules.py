"""The hand-written detector, over a long table of trace events.

Evidence needs the last action call, the first action result after it, and whether an
earlier result was fine. The first and third are one aggregate; the second is one more
after joining the call back, so no trace is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import LABELS

# Tool prefixes, markers, status words, entity shape and weights.
READ_ONLY_PREFIXES = ("get_", "list_", "search_", "stat_", "select_", "describe_", "fetch_", "read_")
SUCCESS_MARKERS = (
    "done",
    "all set",
    "successfully",
    "completed",
    "taken care of",
    "confirmed",
    "has been",
    "is now",
)
NEGATION_MARKERS = (
    "could not",
    "couldn't",
    "did not",
    "didn't",
    "was unable",
    "unable",
    "have not",
    "has not",
    "not confirmed",
    "no confirmation",
    "unverified",
    "failed",
    "pending",
    "queued",
    "no change",
    "nothing changed",
    "will not",
    "before i",
    "can you confirm",
    "please verify",
    "needs to be checked",
    "should verify",
    "tell me whether",
    "which option",
    "say the word",
    "not been able",
)
FAILURE_MARKERS = (
    "could not",
    "couldn't",
    "failed",
    "unable",
    "did not go through",
    "did not succeed",
    "not confirmed",
    "no confirmation",
    "unverified",
    "pending",
    "queued",
    "please verify",
    "needs to be checked",
    "should verify",
    "retry or escalate",
    "not been able",
    "will not report",
)
FAILURE_STATUSES = ("error", "failed", "failure", "denied", "rejected")
NULL_STATUSES = ("timeout", "timed_out", "unknown", "null")
OK_STATUSES = ("ok", "success", "succeeded", "confirmed")
ENTITY = r"[A-Z]{2,5}-\d{2,6}"
BASE_WEIGHT = 0.15
WEIGHTS = {
    "no_action_call": 0.60,
    "missing_result": 0.55,
    "error_status": 0.55,
    "null_result": 0.50,
    "entity_mismatch": 0.60,
    "parameter_mismatch": 0.45,
    "noop": 0.50,
    "stale": 0.30,
}
SCORE_CAP = 0.99
NO_CLAIM_SCORE = 0.02
MAJOR_SHARE = 0.8
MINOR_SHARE = 0.1


def any_marker(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")


def is_read_only(tool: Column) -> Column:
    return tool.rlike("^(?:" + "|".join(READ_ONLY_PREFIXES) + ")")


def action_tools(tool_schema: Column) -> Column:
    return F.filter(F.transform(tool_schema, lambda t: t["name"]), lambda name: ~is_read_only(name))


def with_markers(rows: DataFrame, text: str = "final_text") -> DataFrame:
    low = F.lower(F.col(text))
    return rows.withColumns(
        {
            "has_success_marker": any_marker(low, SUCCESS_MARKERS),
            "negated": any_marker(low, NEGATION_MARKERS),
            "reports_failure": any_marker(low, FAILURE_MARKERS),
        }
    ).withColumn("claim", F.col("has_success_marker") & ~F.col("negated"))


def latest_action(events: DataFrame) -> DataFrame:
    """Per trace: closing text, last action call, first result after it, earliest fine result.

    ``events`` carries ``is_action`` beside the event columns.
    """
    call = F.col("is_action") & (F.col("type") == "assistant_tool_call")
    result = F.col("is_action") & (F.col("type") == "tool_result")
    said = (F.col("type") == "assistant_message") & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    first = events.groupBy("trace_id").agg(
        F.max_by("text", F.when(said, F.col("seq"))).alias("final_text"),
        F.max(F.when(call, F.col("seq"))).alias("last_call"),
        F.min(F.when(result & F.col("status").isin(*OK_STATUSES), F.col("seq"))).alias("first_ok"),
    )
    after = (
        events.where(result)
        .select("trace_id", "seq", "tool", "status", "data")
        .join(first.where("last_call IS NOT NULL").select("trace_id", "last_call"), "trace_id")
        .where("seq > last_call")
        .groupBy("trace_id")
        .agg(F.min_by(F.struct("seq", "tool", "status", "data"), "seq").alias("latest"))
    )
    return first.join(after, "trace_id", "left").withColumn("final_text", F.coalesce("final_text", F.lit("")))


def evidence_signals(traces: DataFrame) -> DataFrame:
    """The eight evidence booleans; ``traces`` joins goal and tool_schema to ``latest_action``."""
    latest, no = F.col("latest"), F.lit(False)
    no_call = F.col("last_call").isNull()
    missing = ~no_call & latest.isNull()
    live = ~no_call & latest.isNotNull()
    status = F.lower(F.coalesce(latest["status"], F.lit("")))
    fields = F.from_json(latest["data"], "map<string,variant>")
    traces = traces.withColumns({"_fields": fields, "_status": status})
    error = live & F.col("_status").isin(*FAILURE_STATUSES)
    empty = live & (F.col("_status").isin(*NULL_STATUSES) | latest["data"].isNull())
    earlier_ok = F.coalesce(F.col("first_ok") < latest["seq"], no)
    fine = live & F.col("_status").isin(*OK_STATUSES) & F.coalesce(F.size("_fields") > 0, no)
    raw = lambda key: F.to_json(F.try_element_at("_fields", F.lit(key)))
    # A zero count and a false flag both read as "nothing changed".
    noop = fine & F.coalesce(
        (raw("changed") == "false") | raw("matched").isin("0", "false") | raw("updated").isin("0", "false"), no
    )
    noop = F.coalesce(noop, no)
    schema = F.filter("tool_schema", lambda t: t["name"] == latest["tool"])
    required = F.coalesce(F.try_element_at(schema, F.lit(1))["required"], F.array().cast("array<string>"))
    entities = F.regexp_extract_all(F.col("goal"), F.lit(r"\b(" + ENTITY + r")\b"), F.lit(1))
    goal = F.lower("goal")

    def text_of(key: Column) -> Column:
        value = F.try_element_at("_fields", key)
        return F.when(F.startswith(F.to_json(value), F.lit('"')), F.try_variant_get(value, "$", "string"))

    absent = lambda key: ~F.map_contains_key("_fields", key)
    entity = lambda v: v.rlike("^" + ENTITY + "$")
    wrong_entity = lambda key: F.coalesce(
        entity(text_of(key)) & (F.size("_entities") > 0) & ~F.array_contains("_entities", text_of(key)), no
    )
    wrong_text = lambda key: F.coalesce(
        ~entity(text_of(key)) & ~F.contains(goal, F.lower(text_of(key))), no
    )
    traces = traces.withColumns({"_required": required, "_entities": entities, "_fine": fine, "noop": noop})
    return traces.withColumns(
        {
            "no_action_call": no_call,
            "missing_result": missing,
            "error_status": F.coalesce(error, no),
            "null_result": F.coalesce(empty, no),
            "stale": F.coalesce((missing & F.col("first_ok").isNotNull()) | ((error | empty) & earlier_ok), no),
            "entity_mismatch": F.coalesce(F.col("_fine") & F.exists("_required", wrong_entity), no),
            "parameter_mismatch": F.coalesce(
                F.col("_fine")
                & F.exists("_required", lambda k: (absent(k) & ~F.col("noop")) | (~absent(k) & wrong_text(k))),
                no,
            ),
        }
    ).drop("_fields", "_status", "_required", "_entities", "_fine")


def rules_score(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score, label, class probabilities and sub-scores from claim and signals."""
    total = F.lit(BASE_WEIGHT)
    fired = F.lit(False)
    for name, weight in WEIGHTS.items():
        total = total + F.when(F.col(name), F.lit(weight)).otherwise(F.lit(0.0))
        fired = fired | F.col(name)
    claim = F.col("claim")
    scored = signals.withColumn(
        "primary_score", F.when(claim, F.least(total, F.lit(SCORE_CAP))).otherwise(F.lit(NO_CLAIM_SCORE))
    )
    score = F.col("primary_score")
    label = (
        F.when(~claim & F.col("reports_failure"), LABELS[2])
        .when(~claim, LABELS[3])
        .when(score >= threshold, LABELS[1])
        .otherwise(LABELS[0])
    )
    scored = scored.withColumn("predicted_label", label)
    # The rest of the mass leans to the label that is not the positive one.
    lead = F.when(claim, LABELS[0]).when(F.col("predicted_label") == LABELS[2], LABELS[2]).otherwise(LABELS[3])
    rest = F.lit(1.0) - score
    mass = []
    for name in LABELS:
        share = score if name == LABELS[1] else rest * F.when(lead == name, MAJOR_SHARE).otherwise(MINOR_SHARE)
        mass += [F.lit(name), share]
    return scored.withColumns(
        {
            "probabilities": F.create_map(*mass),
            "confidence": F.abs(score - 0.5) * 2.0,
            "has_success_claim": F.when(claim, 1.0).otherwise(0.0),
            "tool_evidence_supports_claim": F.when(fired, 0.0).otherwise(1.0),
            "needs_review": score,
            "decision": F.when(score >= threshold, "flag").otherwise("pass"),
        }
    )


def detect(events: DataFrame, traces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The whole detector: long events and (trace_id, goal, tool_schema) to scored traces."""
    tools = traces.select("trace_id", action_tools(F.col("tool_schema")).alias("_tools"))
    marked = events.join(tools, "trace_id", "inner").withColumn(
        "is_action", F.coalesce(F.array_contains("_tools", F.col("tool")), F.lit(False))
    )
    found = traces.select("trace_id", "goal", "tool_schema").join(latest_action(marked), "trace_id", "left")
    found = found.withColumn("final_text", F.coalesce("final_text", F.lit("")))
    return rules_score(with_markers(evidence_signals(found)), threshold)
