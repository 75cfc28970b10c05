"""What a detector may see, and a scan for truth that slipped into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_json
from ..schemas import TRUTH_FIELDS, IntegrityError, refuse_if_any
from .rules import WEIGHTS

INFERENCE_COLUMNS = ("trace_id", "goal", "tool_schema", "events")
TOKEN = r'"(?:[^"\\]++|\\.)*+":?|-?[0-9][0-9.eE+-]*|true|false|null'


def inference_view(traces: DataFrame) -> DataFrame:
    """The columns a detector receives; a truth column among them is refused."""
    view = traces.select(*[c for c in INFERENCE_COLUMNS if c in traces.columns])
    leaked = set(view.columns) & set(TRUTH_FIELDS)
    if leaked:
        raise IntegrityError(f"truth columns in the inference view: {sorted(leaked)}")
    return view


def json_tokens(body: Column) -> Column:
    """The names and scalars of a JSON text, in order, without walking its nesting.

    In canonical form every quoted token followed by a colon is a name.
    """
    return F.regexp_extract_all(canonical_json(body), F.lit(TOKEN), F.lit(0))


def names_of(body: Column) -> Column:
    # Escaped pairs are blanked first, so that strings are plain runs however long they are; no name that is
    # looked for holds an escape, as canonical form writes letters as themselves.
    plain = F.regexp_replace(canonical_json(body), r"\\.", "__")
    return F.regexp_extract_all(plain, F.lit(r'"([^"]*+)":'), F.lit(1))


def leakage(rows: DataFrame, body: str, key: str = "trace_id") -> DataFrame:
    """(key, name) of every truth field at any depth of a JSON column."""
    found = F.array_intersect(names_of(F.col(body)), F.array(*[F.lit(n) for n in TRUTH_FIELDS]))
    return rows.select(key, F.explode(found).alias("name"))


def leakage_paths(rows: DataFrame, body: str, key: str = "trace_id") -> DataFrame:
    """(key, path) of truth fields, for the message of a refusal: walks only leaking rows.

    One recursion step per nesting level, as a recursive query.
    """
    leaking = rows.where(F.arrays_overlap(names_of(F.col(body)), F.array(*[F.lit(n) for n in TRUTH_FIELDS])))
    source = leaking.select(F.col(key).alias("k"), F.try_parse_json(body).alias("v"))
    # No text nests deeper than it has opening brackets.
    deepest = leaking.agg(F.max(F.length(F.regexp_replace(body, r"[^\[{]", "")))).first()[0] or 0
    return (
        rows.sparkSession.sql(
            f"""WITH RECURSIVE walk(k, path, name, v) MAX RECURSION LEVEL {deepest + 2} AS (
              SELECT k, '$', CAST(NULL AS STRING), v FROM {{source}}
              UNION ALL
              SELECT w.k, CASE WHEN e.key IS NULL THEN concat(w.path, '[', e.pos, ']') ELSE concat(w.path, '.', e.key) END, e.key, e.value
              FROM walk w, LATERAL variant_explode(w.v) e)
            SELECT k, path, name FROM walk WHERE path <> '$'""",
            source=source,
        )
        .where(F.col("name").isin(*TRUTH_FIELDS))
        .select(F.col("k").alias(key), "path")
    )


def refuse_leakage(rows: DataFrame, body: str, key: str = "trace_id") -> None:
    refuse_if_any(leakage(rows, body, key), "ground-truth field in a detector's input")


def evidence_strings(events: DataFrame, key: str = "trace_id") -> DataFrame:
    """(key, text): every name and leaf of call arguments and result data, and tool and status."""
    call, result = F.col("type") == "assistant_tool_call", F.col("type") == "tool_result"
    body = F.when(call, F.col("arguments")).when(result, F.col("data"))
    plain = F.transform(
        json_tokens(body),
        lambda t: F.coalesce(
            F.try_variant_get(F.parse_json(F.regexp_replace(t, ":$", "")), "$", "string"), F.lit("None")
        ),
    )
    around = F.when(result, F.array(F.coalesce("tool", F.lit("None")), F.coalesce("status", F.lit("None"))))
    none = F.array().cast("array<string>")
    return events.select(key, F.explode(F.concat(F.coalesce(plain, none), F.coalesce(around, none))).alias("text"))


def verbatim_in_evidence(evidence: DataFrame, described: DataFrame, key: str = "trace_id") -> DataFrame:
    """Traces whose described target stands, case aside, inside some evidence text."""
    hit: Column = F.contains(F.lower("text"), F.lower("described_target"))
    return evidence.join(described, key, "inner").where(hit).select(key).distinct()


def clean_subclass_problems(
    traces: DataFrame, evidence: DataFrame, detected: DataFrame, focus: str, control: str, min_domains: int = 4
) -> DataFrame:
    """Breaches of the focus fault's contract, as (trace_id, problem) rows.

    ``detected`` is the rules detector's output: signals and decision per trace.
    """
    mine = traces.where(F.col("fault_type") == focus)
    domains = mine.agg(F.count_distinct("domain").alias("n")).where(F.col("n") < min_domains)
    fired = F.lit(False)
    for name in WEIGHTS:
        fired = fired | F.col(name)
    judged = detected.join(traces.select("trace_id", "fault_type"), "trace_id", "inner")
    flagged = F.col("decision") == "flag"
    row = lambda df, problem: df.select("trace_id", F.lit(problem).alias("problem"))
    return (
        domains.select(F.lit(None).cast("string").alias("trace_id"), F.lit("too_few_domains").alias("problem"))
        .unionByName(row(verbatim_in_evidence(evidence, mine.select("trace_id", "described_target")), "verbatim_target"))
        .unionByName(row(judged.where((F.col("fault_type") == focus) & fired), "signal_fired"))
        .unionByName(row(judged.where((F.col("fault_type") == focus) & flagged), "focus_flagged"))
        .unionByName(row(judged.where((F.col("fault_type") == control) & flagged), "control_flagged"))
    )
