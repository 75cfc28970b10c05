"""Judge requests and replies as columns: every failure is named, none is guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import LABELS
from .budget import canonical_events, event_json
from .text import json_string

# Reply keys, refusal codes and the parameters that may be dropped.
VERDICT_KEY = "verdict"
SUB_SCORES = ("has_success_claim", "tool_evidence_supports_claim", "needs_review")
SUB_SCORE_FIELD = "noul"
UNSUPPORTED_CODES = ("unsupported_value", "unsupported_parameter")
DROPPABLE = ("temperature", "top_p")
PARSE_FAILURE = "ParseFailureError: "
SCHEMA_NAME = "trace_verdict"


def state_json(goal: Column, tools: Column, events: Column, rule: Column) -> Column:
    """The state a judge is shown: goal, tools, events without absent fields, the rule."""
    entry = lambda t: F.concat(
        F.lit('{"name":'), json_string(t["name"]), F.lit(',"required":'), F.to_json(t["required"]), F.lit("}")
    )
    return F.concat(
        F.lit('{"evaluation_rule":'), json_string(rule), F.lit(',"events":['),
        F.concat_ws(",", F.transform(canonical_events(events), lambda e: event_json(e["seq"], e))), F.lit('],"goal":'), json_string(goal),
        F.lit(',"tool_schema":['), F.concat_ws(",", F.transform(tools, entry)), F.lit("]}"),
    )


def structured_request(model: Column, state: Column, questions: Column) -> Column:
    return F.concat(
        F.lit('{"model":'), json_string(model), F.lit(',"questions":'), questions, F.lit(',"state":'), state, F.lit("}")
    )


def chat_request(model: Column, instructions: Column, state: Column, schema: Column, max_tokens: int, temperature: float | None = 0.0) -> Column:
    """The chat body; ``temperature=None`` is a model that refuses the parameter."""
    heat = "" if temperature is None else f',"temperature":{temperature}'
    return F.concat(
        F.lit(f'{{"max_completion_tokens":{max_tokens},"messages":[{{"content":'), json_string(instructions),
        F.lit(',"role":"developer"},{"content":'), json_string(state), F.lit(',"role":"user"}],"model":'), json_string(model),
        F.lit(f',"response_format":{{"json_schema":{{"name":"{SCHEMA_NAME}","schema":'), schema,
        F.lit(',"strict":true},"type":"json_schema"}' + heat + "}"),
    )


def first_error(*checks: tuple[Column, str | Column]) -> Column:
    """The first failing check's message as a parse failure, NULL when all hold."""
    out = None
    for failed, message in checks:
        text = F.concat(F.lit(PARSE_FAILURE), F.lit(message) if isinstance(message, str) else message)
        cond = F.coalesce(failed, F.lit(False))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def labels_array() -> Column:
    return F.array(*[F.lit(name) for name in LABELS])


def parse_structured(rows: DataFrame, body: str = "body", sub_field: str = SUB_SCORE_FIELD) -> DataFrame:
    """Typed-judge replies: label, map over the four labels, sub-scores, usage, error."""
    shape = "struct<answers:map<string,variant>,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint>>"
    r = rows.withColumn("_r", F.from_json(body, shape))
    r = r.withColumn("_v", F.try_element_at("_r.answers", F.lit(VERDICT_KEY)))
    r = r.withColumns(
        {
            "_p": F.try_variant_get("_v", "$.probabilities", "map<string,double>"),
            "_choice": F.try_variant_get("_v", "$.choice", "string"),
        }
    )
    # Each is read by a check and by the result, so it is taken out of the reply once.
    r = r.withColumns(
        {
            **{f"_sub_{k}": F.try_variant_get(F.try_element_at("_r.answers", F.lit(k)), f"$.{sub_field}", "double") for k in SUB_SCORES},
            "_unknown": F.array_except(F.map_keys("_p"), labels_array()),
        }
    )
    sub = {k: F.col(f"_sub_{k}") for k in SUB_SCORES}
    unknown = F.col("_unknown")
    error = first_error(
        (F.col("_r.answers").isNull(), "response has no 'answers' object"),
        (F.col("_v").isNull(), "response has no 'verdict' answer"),
        (F.col("_p").isNull(), "verdict answer has no 'probabilities' map"),
        (F.size(unknown) > 0, F.concat(F.lit("verdict returned an unknown option "), F.try_element_at(unknown, F.lit(1)))),
        (~F.col("_choice").isin(*LABELS) | F.col("_choice").isNull(), "verdict 'choice' is not one of the four labels"),
        *[(value.isNull(), f"response has no '{k}' answer") for k, value in sub.items()],
    )
    probability = [x for name in LABELS for x in (F.lit(name), F.coalesce(F.try_element_at("_p", F.lit(name)), F.lit(0.0)))]
    return finish(r, error, F.create_map(*probability), sub, F.try_variant_get("_v", "$.confidence", "double"),
                  F.col("_r.usage.input_tokens"), F.col("_r.usage.output_tokens"), F.col("_r.model"))


def probability_error(value: Column, name: str) -> list[tuple[Column, str]]:
    return [(value.isNull(), f"{name} is not a number"), (~value.between(0.0, 1.0), f"{name} is outside [0, 1]")]


def parse_chat(rows: DataFrame, body: str = "body") -> DataFrame:
    """Chat replies: the answer is JSON inside the first choice's message."""
    shape = (
        "struct<choices:array<struct<finish_reason:string,message:struct<content:string,refusal:string>>>,"
        "model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
    )
    r = rows.withColumn("_r", F.from_json(body, shape))
    r = r.withColumn("_c", F.try_element_at("_r.choices", F.lit(1)))
    content = F.col("_c.message.content")
    r = r.withColumn("_a", F.from_json(content, "map<string,variant>"))
    r = r.withColumn("_v", F.try_element_at("_a", F.lit(VERDICT_KEY)))
    r = r.withColumns(
        {
            "_p": F.try_variant_get("_v", "$.probabilities", "map<string,variant>"),
            "_choice": F.try_variant_get("_v", "$.choice", "string"),
            "_json": F.try_parse_json(content),
        }
    )
    # Each number is read by several checks and by the result, so it is taken out of the reply once.
    r = r.withColumns(
        {
            **{f"_prob_{n}": F.try_variant_get(F.try_element_at("_p", F.lit(n)), "$", "double") for n in LABELS},
            **{f"_sub_{k}": F.try_variant_get(F.try_element_at("_a", F.lit(k)), "$", "double") for k in SUB_SCORES},
            "_confidence": F.try_variant_get("_v", "$.confidence", "double"),
        }
    )
    prob = {n: F.col(f"_prob_{n}") for n in LABELS}
    sub = {k: F.col(f"_sub_{k}") for k in SUB_SCORES}
    confidence = F.col("_confidence")
    error = first_error(
        (F.col("_c").isNull(), "response has no 'choices' array"),
        (F.coalesce(F.length("_c.message.refusal"), F.lit(0)) > 0, F.concat(F.lit("model refused: "), F.substring("_c.message.refusal", 1, 200))),
        (F.col("_c.finish_reason") == "length", "finish_reason is 'length': the answer was cut off"),
        (F.coalesce(F.trim(content), F.lit("")) == "", "choices[0].message.content is empty"),
        (F.col("_json").isNull(), "message content is not JSON"),
        (~F.startswith(F.schema_of_variant("_json"), F.lit("OBJECT")), "message content is not a JSON object"),
        (F.col("_v").isNull() | ~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), "answer has no 'verdict' object"),
        (F.col("_p").isNull(), "verdict has no 'probabilities' map"),
        *[check for n in LABELS for check in [(~F.map_contains_key("_p", n), f"verdict probabilities omit '{n}'"), *probability_error(prob[n], f"probabilities.{n}")]],
        (F.size(F.array_except(F.map_keys("_p"), labels_array())) > 0, "verdict returned unknown options"),
        (~F.col("_choice").isin(*LABELS) | F.col("_choice").isNull(), "verdict 'choice' is not one of the four labels"),
        *[check for k in SUB_SCORES for check in probability_error(sub[k], k)],
        (~confidence.between(0.0, 1.0), "verdict.confidence is outside [0, 1]"),
    )
    return finish(r, error, F.create_map(*[x for n in LABELS for x in (F.lit(n), prob[n])]), sub, confidence,
                  F.col("_r.usage.prompt_tokens"), F.col("_r.usage.completion_tokens"), F.col("_r.model"))


def finish(r: DataFrame, error: Column, probabilities: Column, sub: dict, confidence: Column, tokens_in: Column, tokens_out: Column, model: Column) -> DataFrame:
    r = r.withColumn("error", error)
    ok = F.col("error").isNull()
    keep = lambda c: F.when(ok, c)
    out = r.withColumns(
        {
            "probabilities": keep(probabilities),
            "predicted_label": keep(F.col("_choice")),
            "confidence": keep(confidence),
            **{k: keep(v) for k, v in sub.items()},
            "input_tokens": keep(F.coalesce(tokens_in, F.lit(0))),
            "output_tokens": keep(F.coalesce(tokens_out, F.lit(0))),
            "reply_model": model,
        }
    )
    return out.withColumn("primary_score", F.try_element_at("probabilities", F.lit(LABELS[1]))).drop(
        *[c for c in out.columns if c.startswith("_")]
    )


def reply_error(http_status: Column, body: Column, transport_error: Column, parse_error: Column) -> Column:
    """What failed, if anything: transport, a body that is not JSON, HTTP, or the parse."""
    return (
        F.when(http_status.isNull(), F.coalesce(transport_error, F.lit("no response")))
        .when(F.try_parse_json(body).isNull(), F.lit(PARSE_FAILURE + "response body is not JSON"))
        .when(http_status >= 400, F.coalesce(transport_error, F.concat(F.lit("HTTP "), http_status.cast("string"))))
        .when(parse_error.isNotNull(), parse_error)
    )


def unsupported_parameter(body: Column) -> Column:
    """STRUCT<param, code, message> when a body refuses a droppable parameter, else NULL."""
    get = lambda path: F.get_json_object(body, f"$.error.{path}")
    return F.when(
        get("code").isin(*UNSUPPORTED_CODES) & get("param").isin(*DROPPABLE),
        F.struct(get("param").alias("param"), get("code").alias("code"), F.coalesce(get("message"), F.lit("")).alias("message")),
    )


def deviation_summary(refusals: DataFrame, order: str = "ord") -> DataFrame:
    """One row per refused parameter: how often, and the first trace that met it."""
    return refusals.groupBy("provider", F.col("refused.param").alias("parameter")).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by("trace_id", order).alias("first_seen_trace_id"),
        F.min("refused.code").alias("error_code"),
    )


def drop_parameters(allowed: Sequence[str]) -> Sequence[str]:
    bad = sorted(set(allowed) - set(DROPPABLE))
    if bad:
        raise ValueError(f"may not drop request parameters {bad}")
    return allowed
