"""Structured replies: each answer is taken out of a reply once, and odd replies keep their errors."""

import json

from tracegauge.functions import replies as Y

SUBS = {"has_success_claim": {"noul": 1}, "tool_evidence_supports_claim": {"noul": 0.5}, "needs_review": {"noul": 0.25}}


def verdict(**changes):
    return {"choice": "supported_success", "probabilities": {"supported_success": 0.75, "unsupported_success": 0.25}, **changes}


def test_each_answer_is_taken_out_once_and_errors_are_named(spark):
    bodies = [
        json.dumps({"answers": {"verdict": verdict(), **SUBS}}),
        json.dumps({"answers": {"verdict": verdict(probabilities={"x": 1}), **SUBS}}),
        json.dumps({"answers": {"verdict": verdict(choice=7), **SUBS}}),
        json.dumps({"answers": {"verdict": verdict(), **SUBS, "needs_review": {"noul": "no"}}}),
        json.dumps({"answers": {"verdict": verdict(probabilities=None), **SUBS}}),
        json.dumps({"answers": SUBS}),
        "oops",
        None,
    ]
    rows = Y.parse_structured(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    got = [r.error and r.error.removeprefix(Y.PARSE_FAILURE) for r in rows.orderBy("id").collect()]
    assert got == [
        None, "verdict returned an unknown option x", "verdict 'choice' is not one of the four labels", "response has no 'needs_review' answer",
        "verdict answer has no 'probabilities' map", "response has no 'verdict' answer", "response has no 'answers' object", "response has no 'answers' object",
    ]
    first = rows.orderBy("id").first()
    assert (first.primary_score, first.has_success_claim, first.tool_evidence_supports_claim, first.needs_review) == (0.25, 1.0, 0.5, 0.25)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.noul") == 3 and plan.count("array_except(") == 1
