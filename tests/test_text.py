"""Canonical text, redaction, leakage, budgets, replies and the rules detector."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracegauge.functions import budget as B, replies as Y, scores as S, text as X
from tracegauge.operators import leakage as K, rules as U, textfeatures as W
from tracegauge.schemas import EVENT, LABELS, TOOL, IntegrityError

DIGEST = hashlib.sha256(b"x").hexdigest()


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("value", [{"b": 1, "a": [1, {"z": None, "y": "é/\n\"q\""}]}, {}, {"k": {"n": 1.5}}])
def test_canonical_json(spark, value):
    want = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert one(spark, json.dumps(value, indent=2), X.canonical_json) == want
    assert one(spark, json.dumps(value), lambda c: X.sha256_text(X.canonical_json(c))) == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("text", ["plain", 'q"uote', "back\\slash", "new\nline", "tab\t", "", "é/"])
def test_json_string(spark, text):
    assert one(spark, text, X.json_string) == json.dumps(text, ensure_ascii=False)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Authorization: Bearer abc.DEF-1", "Authorization: Bearer [REDACTED]"),
        ("key sk-ABCDEFGHIJKLMNOP end", "key [REDACTED] end"),
        ("x " + "a" * 40 + " y", "x [REDACTED] y"),
        ("short words stay", "short words stay"),
        (DIGEST, DIGEST),
        (f"sha {DIGEST} ok", f"sha {DIGEST} ok"),
        ("a" + DIGEST, "[REDACTED]"),
        ("https://host/path?x=1", "https://host/path?x=1"),
    ],
)
def test_redact_text(spark, text, want):
    assert one(spark, text, X.redact_text) == want


def test_live_secret_goes_even_from_structural_columns(spark):
    secret = "0123456789abcdef" * 4
    rows = spark.createDataFrame([(f"id-{secret}", "m" * 36, f"body {secret}", "pw")], "trace_id string, model_id string, note string, password string")
    armed = X.with_secrets(rows, X.secret_table(spark, [secret, "short"]))
    got = X.redact_columns(armed, F.col("secrets")).drop("secrets").first()
    assert (got["trace_id"], got["model_id"], got["note"], got["password"]) == ("id-[REDACTED]", "m" * 36, "body [REDACTED]", "[REDACTED]")
    assert secret not in armed._jdf.queryExecution().toString()


def test_redact_json_by_key(spark):
    body = {"Token": "abc", "trace_id": "q" * 40, "deep": [{"note": "q" * 40, "api_key": 1}], "n": 5}
    got = spark.createDataFrame([(json.dumps(body),)], "b string").select(X.redact_json("b", F.array().cast("array<string>"))).first()[0]
    assert json.loads(got) == {"Token": "[REDACTED]", "trace_id": "q" * 40, "deep": [{"note": "[REDACTED]", "api_key": "[REDACTED]"}], "n": 5}


def test_leakage_at_any_depth(spark):
    rows = spark.createDataFrame(
        [("a", '{"x":{"label":1},"l":[{"oracle":2}]}'), ("b", '{"t":"the \\"label\\": word","n":["oracle"]}')], "trace_id string, body string"
    )
    assert sorted((r[0], r[1]) for r in K.leakage(rows, "body").collect()) == [("a", "label"), ("a", "oracle")]
    assert sorted(r[1] for r in K.leakage_paths(rows, "body").collect()) == ["$.l[0].oracle", "$.x.label"]
    with pytest.raises(IntegrityError):
        K.refuse_leakage(rows, "body")


def test_fingerprint_ignores_order(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("k"))
    first = X.table_fingerprint(rows).first()
    assert first == X.table_fingerprint(rows.repartition(11).orderBy(F.desc("id")).select("k", "id")).first()
    assert first["fingerprint"] != X.table_fingerprint(rows.where("id < 199")).first()["fingerprint"]


# -- budget --------------------------------------------------------------------------


def event_dump(e, seq=None):
    d = {k: v for k, v in zip(EVENT.names, e, strict=True) if v is not None}
    for k in ("arguments", "data"):
        if k in d:
            d[k] = json.loads(d[k])
    if seq is not None:
        d["seq"] = seq
    return len(json.dumps(d, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def trace(n, payload):
    rows = []
    for i in range(n):
        rows.append((2 * i, "assistant_tool_call", "t", json.dumps({"a": "é" * (i % 5)}), None, None, None))
        rows.append((2 * i + 1, "tool_result", "t", None, "ok", json.dumps({"v": "x" * payload}), None))
    return [*rows, (2 * n, "assistant_message", None, None, None, None, 'All "done"')]


def expected_cut(events, envelope, limit):
    """A plain walk over shrinking windows, as the oracle of the column expression."""
    marker = lambda d: event_dump((-1, "tool_result", "__elided__", None, "elided", json.dumps({"dropped_events": d, "note": f"{d}{B.MARKER_NOTE}"}), None))
    lens = [event_dump(e) for e in events]
    if envelope + sum(lens) <= limit:
        return None
    for head, tail in B.window_steps(len(events)):
        dropped = max(0, len(events) - head - tail)
        size = envelope + (sum(lens) if not dropped else sum(lens[:head]) + sum(lens[len(lens) - tail :]) + marker(dropped))
        if size <= limit:
            break
    return dropped


@pytest.mark.parametrize("n,payload,limit", [(2, 5, 10_000), (40, 60, 3_000), (40, 60, 1_500), (3, 300, 900), (30, 500, 600), (7, 10, 700)])
def test_middle_elision(spark, n, payload, limit):
    events = trace(n, payload)
    rows = spark.createDataFrame([("t1", "goal", [("t", ["a"])], events)], f"trace_id string, goal string, tool_schema {TOOL.simpleString().join(['array<', '>'])}, events array<{EVENT.simpleString()}>")
    row = B.fit_events(rows, F.lit(limit), F.lit("rule")).first()
    envelope = len(json.dumps({"goal": "goal", "tool_schema": [{"name": "t", "required": ["a"]}], "events": [], "evaluation_rule": "rule"}, separators=(",", ":")))
    want = expected_cut(events, envelope, limit)
    if want is None:
        assert row["truncation"] is None and len(row["fitted"]) == len(events)
        return
    t = row["truncation"]
    assert t["dropped_events"] == want and t["original_events"] == len(events)
    assert t["original_state_chars"] == envelope + sum(event_dump(e) for e in events)
    assert t["final_state_chars"] == envelope + sum(event_dump(tuple(e), i) for i, e in enumerate(row["fitted"]))
    assert [e["seq"] for e in row["fitted"]] == list(range(t["kept_events"]))
    assert t["fits"] == (t["final_state_chars"] <= limit)
    assert row["fitted"][-1]["text"] == 'All "done"'


def test_one_oversized_payload_is_shortened_not_dropped(spark):
    events = [(0, "tool_result", "t", None, "ok", json.dumps({"v": "x" * 50_000}), None), (1, "assistant_message", None, None, None, None, "hi")]
    rows = spark.createDataFrame([("t1", "g", [], events)], f"trace_id string, goal string, tool_schema array<{TOOL.simpleString()}>, events array<{EVENT.simpleString()}>")
    t = B.fit_events(rows, F.lit(10_000), F.lit("r")).first()["truncation"]
    assert (t["shortened_payloads"], t["dropped_events"], t["fits"]) == (1, 0, True)


def test_windows_never_go_below_one():
    assert B.window_steps(30)[0] == (4, 12) and B.window_steps(30)[-1] == (1, 1) and len(B.window_steps(30)) == 15
    assert B.window_steps(0) == [(0, 0)] and B.window_steps(1) == [(1, 0)]


# -- replies ----------------------------------------------------------------------------

GOOD = {
    "answers": {
        "verdict": {"choice": LABELS[0], "probabilities": {LABELS[0]: 0.7, LABELS[1]: 0.3}, "confidence": 0.5},
        "has_success_claim": {"noul": 1}, "tool_evidence_supports_claim": {"noul": 0.5}, "needs_review": {"noul": 0.1},
    },
    "usage": {"input_tokens": 3, "output_tokens": 4}, "model": "m1",
}


def broken(change):
    body = json.loads(json.dumps(GOOD))
    change(body)
    return json.dumps(body)


def test_structured_replies(spark):
    cases = [
        (json.dumps(GOOD), None),
        ("{}", "'answers'"),
        (broken(lambda b: b["answers"].pop("verdict")), "'verdict'"),
        (broken(lambda b: b["answers"]["verdict"].pop("probabilities")), "'probabilities'"),
        (broken(lambda b: b["answers"]["verdict"]["probabilities"].update(zzz=1)), "zzz"),
        (broken(lambda b: b["answers"]["verdict"].update(choice="zzz")), "'choice'"),
        (broken(lambda b: b["answers"].pop("needs_review")), "'needs_review'"),
        (broken(lambda b: b["answers"]["has_success_claim"].pop("noul")), "'has_success_claim'"),
    ]
    got = Y.parse_structured(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")).orderBy("i").collect()
    for row, (_, want) in zip(got, cases, strict=True):
        if want is None:
            assert row["error"] is None and row["primary_score"] == 0.3 and row["probabilities"][LABELS[3]] == 0.0
            assert (row["input_tokens"], row["reply_model"], row["needs_review"]) == (3, "m1", 0.1)
        else:
            assert row["error"].startswith(Y.PARSE_FAILURE) and want in row["error"] and row["primary_score"] is None


def test_unsupported_parameter(spark):
    bodies = [("unsupported_value", "temperature"), ("unsupported_value", "response_format"), ("rate_limit", "top_p")]
    rows = spark.createDataFrame([(json.dumps({"error": {"code": c, "param": p, "message": "m"}}),) for c, p in bodies], "b string")
    got = [r[0] for r in rows.select(Y.unsupported_parameter(F.col("b"))).collect()]
    assert got[0]["param"] == "temperature" and got[1] is None and got[2] is None
    with pytest.raises(ValueError):
        Y.drop_parameters(["response_format"])


# -- rules ------------------------------------------------------------------------------

TOOLS = [("set_x", ["id", "v"]), ("get_x", [])]
CALL = ("assistant_tool_call", "set_x", "{}", None, None, None)


def result(status, data, tool="set_x"):
    return ("tool_result", tool, None, status, None if data is None else json.dumps(data), None)


def say(text):
    return ("assistant_message", None, None, None, None, text)


@pytest.mark.parametrize(
    "events,goal,fired,label",
    [
        ([CALL, result("ok", {"id": "AB-12", "v": "blue"}), say("Done")], "set AB-12 to Blue", set(), LABELS[0]),
        ([say("All set")], "g", {"no_action_call"}, LABELS[1]),
        ([CALL, say("done")], "g", {"missing_result"}, LABELS[1]),
        ([CALL, result("ok", {}), CALL, say("done")], "g", {"missing_result", "stale"}, LABELS[1]),
        ([CALL, result("FAILED", {"id": 1}), say("done")], "g", {"error_status"}, LABELS[1]),
        ([CALL, result("timeout", {"id": 1}), say("done")], "g", {"null_result"}, LABELS[1]),
        ([result("ok", {"id": 1}), CALL, result("ok", None), say("done")], "g", {"null_result", "stale"}, LABELS[1]),
        ([CALL, result("ok", {"changed": False}), say("done")], "g", {"noop"}, LABELS[1]),
        ([CALL, result("ok", {"matched": False}), say("done")], "g", {"noop"}, LABELS[1]),
        ([CALL, result("ok", {"id": "AB-13", "v": 5}), say("done")], "fix AB-12", {"entity_mismatch"}, LABELS[1]),
        ([CALL, result("ok", {"id": "AB-13", "v": 5}), say("done")], "fix it", set(), LABELS[0]),
        ([CALL, result("ok", {"v": "red"}), say("done")], "paint it red", {"parameter_mismatch"}, LABELS[1]),
        ([CALL, result("ok", {"id": 1, "v": 1}), say("I could not confirm; it failed")], "g", set(), LABELS[2]),
        ([CALL, result("ok", {"id": 1, "v": 1}), say("Which option, done?")], "g", set(), LABELS[3]),
    ],
)
def test_rules(spark, events, goal, fired, label):
    rows = [("t", i, *e) for i, e in enumerate(events)]
    long = spark.createDataFrame(rows, "trace_id string, seq int, type string, tool string, arguments string, status string, data string, text string")
    traces = spark.createDataFrame([("t", goal, TOOLS)], f"trace_id string, goal string, tool_schema array<{TOOL.simpleString()}>")
    got = U.detect(long, traces).first()
    assert {n for n in U.WEIGHTS if got[n]} == fired
    assert got["predicted_label"] == label
    assert sum(got["probabilities"].values()) == pytest.approx(1.0)


def test_word_weights_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "red red blue"), (2, "red blue"), (3, "x green")], "d int, t string")
    got = {(r["d"], r["term"]): r["weight"] for r in W.word_tfidf(docs, "d", "t").collect()}
    idf = math.log(4 / 3) + 1
    red, blue, pair = (1 + math.log(2)) * idf, idf, idf
    norm = math.sqrt(red**2 + blue**2 + pair**2)
    assert got[(1, "red")] == pytest.approx(red / norm) and (3, "green") not in got and (1, "red red") not in got


def test_char_grams_of_short_words(spark):
    docs = spark.createDataFrame([(1, "a abcd"), (2, "a abcd")], "d int, t string")
    terms = {r["term"] for r in W.char_counts(docs, "d", "t").collect()}
    assert terms == {" a ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "}


def test_backoff(spark):
    rows = spark.createDataFrame([(1, None, 0.0), (4, None, 0.0), (9, None, 1.0), (1, 7.0, 0.5)], "a int, r double, u double")
    got = [r[0] for r in rows.select(S.backoff_delay(F.col("a"), F.col("r"), F.col("u"))).collect()]
    assert got == [0.5, 4.0, 3.75, 7.0]


def test_cost_needs_a_verified_price(spark):
    rows = spark.createDataFrame([(10, 20, 1.0, 2.0, True), (10, 20, 0.0, 0.0, True), (10, 20, 1.0, 2.0, False), (None, None, 1.0, 2.0, True), (10, 20, None, 2.0, True)],
                                 "i bigint, o bigint, a double, b double, v boolean")
    got = [r[0] for r in rows.select(S.cost_usd(*[F.col(c) for c in "ioabv"])).collect()]
    assert got == [pytest.approx(50 / 1e6), 0.0, None, None, None]


def test_final_assistant_text_of_events_in_array_order(spark):
    kind = "array<struct<type:string,text:string>>"
    said = lambda *texts: [("assistant_message", t) for t in texts]
    for events, want in (([*said("a", "b"), ("tool_result", "c"), *said("", None)], "b"), ([("user_message", "x")], ""), ([], ""), (None, "")):
        assert one(spark, events, X.final_assistant_text, kind) == want


def test_final_text_of_a_conversation_is_an_aggregate_of_bounded_state(spark, tmp_path):
    from tracegauge.plans import load

    rows = [(1, 0, "assistant", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", ""), (1, 3, "user", "c"), (2, 0, "user", "d"), (3, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = load()[0]["p8_final_assistant_text"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, "b"), (2, ""), (3, "")]
    assert "collect_list" not in out._jdf.queryExecution().toString()
