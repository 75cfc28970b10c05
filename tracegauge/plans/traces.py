"""Queries over trace text and events: ingest rules, evidence, budgets, replies, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import budget as B, labels as L, replies as Y, scores as S, text as X
from ..session import spread
from ..operators import leakage as K, rules as U, textfeatures as W
from ..sources import release as R
from . import corpus
from .corpus import with_views
from .registry import query

STRIP = "\\s"


def docs(spark, sf):
    return corpus.base(spark, sf, "documents")


def orders(spark, sf):
    return corpus.base(spark, sf, "orders")


# -- ingest rules ---------------------------------------------------------------------

_STATUS = """CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Success ' WHEN 3 THEN 'completed' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'Succeeded' WHEN 7 THEN 'maybe' ELSE 'complete' END"""
_INGEST = f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {_STATUS} AS status, CASE WHEN o_totalprice > 3e5 THEN NULL ELSE o_totalprice > 1e5 END AS truth,
CASE WHEN o_orderpriority < '4' THEN CAST(substr(o_orderpriority, 1, 1) AS INT) END AS difficulty, CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'goal' END AS goal FROM orders),
c AS (SELECT *, CASE WHEN trim(status) = '' THEN NULL WHEN lower(trim(status)) IN ('success','succeeded','complete','completed') THEN 'success'
WHEN lower(trim(status)) IN ('failed','incomplete') THEN 'failure' WHEN status IS NOT NULL THEN 'unrecognised' END AS claim FROM o),
l AS (SELECT *, CASE WHEN claim IS NULL THEN 'no_success_claim' WHEN claim = 'failure' THEN 'reported_failure_or_uncertainty' WHEN claim = 'success' AND truth THEN 'supported_success'
WHEN claim = 'success' AND NOT truth THEN 'unsupported_success' END AS label, CASE WHEN goal = '' THEN 'no_goal' WHEN claim = 'success' AND truth IS NULL THEN 'no_ground_truth' END AS drop_reason FROM c)"""


def ingest_rows(spark, sf):
    o = orders(spark, sf).withColumns({
        "status": F.expr(_STATUS), "truth": F.when(F.col("o_totalprice") <= 3e5, F.col("o_totalprice") > 1e5),
        "difficulty": F.when(F.col("o_orderpriority") < "4", F.substring("o_orderpriority", 1, 1).cast("int")),
        "goal": F.when(F.col("o_custkey") % 17 == 0, "").otherwise("goal")})
    o = o.withColumn("claim", L.normalise_claim(F.col("status")))
    return o.withColumns({"label": L.label_for(F.col("claim"), F.col("truth")), "drop_reason": L.drop_reason(F.col("goal"), F.col("claim"), F.col("truth"))})


@query("f7_f8_f9_label_rule", _INGEST + """ SELECT o_orderkey, claim, label, CASE label WHEN 'supported_success' THEN 'real_supported_completion' WHEN 'reported_failure_or_uncertainty' THEN 'real_reported_failure'
WHEN 'no_success_claim' THEN 'real_no_completion_claim' WHEN 'unsupported_success' THEN CASE difficulty WHEN 1 THEN 'real_unsupported_completion_easy' WHEN 3 THEN 'real_unsupported_completion_hard' ELSE 'real_unsupported_completion_medium' END END AS fault_type FROM l""")
def label_rule(spark, sf):
    rows = ingest_rows(spark, sf)
    return rows.select("o_orderkey", "claim", "label", L.fault_for(F.col("label"), F.col("difficulty")).alias("fault_type"))


@query("p7_ingest_filter", _INGEST + " SELECT count(*) AS seen, count(*) FILTER (WHERE drop_reason IS NULL) AS kept, count(*) FILTER (WHERE drop_reason = 'no_goal') AS dropped_no_goal, count(*) FILTER (WHERE drop_reason = 'no_ground_truth') AS dropped_no_ground_truth FROM l")
def ingest_filter(spark, sf):
    return L.ingest_counts(ingest_rows(spark, sf))


@query("f5_trace_and_scenario_ids", "SELECT o_orderkey, concat('corpus/', o_orderstatus, '/', o_orderpriority, '/', concat('t', CAST(o_custkey AS STRING), '_', CAST(o_orderkey % 3 AS STRING))) AS trace_id, concat('t', CAST(o_custkey AS STRING)) AS scenario_id FROM orders")
def ids(spark, sf):
    task = F.concat(F.lit("t"), F.col("o_custkey").cast("string"), F.lit("_"), (F.col("o_orderkey") % 3).cast("string"))
    return orders(spark, sf).select("o_orderkey", X.trace_id_of("corpus", F.col("o_orderstatus"), F.col("o_orderpriority"), task).alias("trace_id"), R.scenario_of(task).alias("scenario_id"))


@query("p9_licence_gate", """WITH q AS (SELECT DISTINCT source AS corpus FROM documents), l AS (SELECT source AS corpus, bool_or(lang = 'en' AND doc_id % 70 = 0) AS ok FROM documents WHERE lang <> 'de' GROUP BY source)
SELECT corpus FROM q WHERE corpus NOT IN (SELECT corpus FROM l WHERE ok)""")
def licences(spark, sf):
    d = docs(spark, sf).select(F.col("source").alias("corpus"), "lang", "doc_id")
    dim = d.where("lang <> 'de'").groupBy("corpus").agg(F.bool_or((F.col("lang") == "en") & (F.col("doc_id") % 70 == 0)).alias("permits_this_use"))
    return R.licence_violations(d.select("corpus").distinct(), dim)


_SEG = "regexp_extract(regexp_replace(url, '^https?://[^/]+', ''), '^/*([^/?#]+)', 1)"


@query("a39_primary_domain", f"""WITH c AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, {_SEG} AS app FROM pages), k AS (SELECT host, app, count(*) AS n FROM c WHERE app <> '' AND app NOT IN ('fr') GROUP BY ALL)
SELECT host, app FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, app) AS r FROM k) q WHERE r = 1""")
def primary_domain(spark, sf):
    calls = corpus.base(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract(R.app_of_url(F.regexp_replace("url", "^https?://[^/]+", "")), "^([^?#]*)", 1).alias("app"))
    return R.most_called(calls.where("app <> ''"), ["host"], ("fr",))


_LINES = "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


def interactions():
    line = lambda x, i: F.struct(F.when(i % 3 == 0, F.concat(F.lit("apis.app"), F.lit("_x.do_"), (F.length(x) % 4).cast("string"), F.lit("() complete_task(status='s"), F.length(x).cast("string"), F.lit("')"))).otherwise(F.lit("pass")).alias("code"), x.alias("output"))
    return F.transform(F.split("text", "\n"), line)


@query("f6_terminal_status", _LINES + " SELECT doc_id, concat('s', CAST(length(ls[CAST((len(ls) - 1) // 3 * 3 + 1 AS BIGINT)]) AS STRING)) AS status FROM d")
def terminal(spark, sf):
    return docs(spark, sf).select("doc_id", R.terminal_status(interactions()).alias("status"))


@query("a40_touched_tools", _LINES + ", e AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM d) SELECT doc_id, string_agg(DISTINCT concat('app_x.do_', CAST(length(x) % 4 AS STRING)), ',' ORDER BY concat('app_x.do_', CAST(length(x) % 4 AS STRING))) AS tools FROM e WHERE i % 3 = 0 GROUP BY doc_id")
def touched(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat_ws(",", R.touched_tools(interactions())).alias("tools"))


@query("f40_w3_build_events", _LINES + """, e AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM d)
SELECT doc_id, CAST(2 * i AS INT) AS seq, 'assistant_tool_call' AS type, CAST(NULL AS STRING) AS status, NULL AS output_chars FROM e UNION ALL
SELECT doc_id, CAST(2 * i + 1 AS INT), 'tool_result', 'returned', CAST(length(x) AS INT) FROM e UNION ALL SELECT DISTINCT doc_id, CAST(2 * n AS INT), 'assistant_message', NULL, NULL FROM e""")
def build_events(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.explode(R.build_events(interactions())).alias("e"))
    return rows.select("doc_id", "e.seq", "e.type", "e.status", F.length(F.get_json_object("e.data", "$.output")).alias("output_chars"))


@query("p8_final_assistant_text", "SELECT conv_id, coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant' AND text <> ''), '') AS final_text FROM conversations GROUP BY conv_id")
def final_text(spark, sf):
    said = (F.col("role") == "assistant") & (F.col("text") != "")
    last = F.max_by("text", F.when(said, F.struct("turn", "text")))
    return corpus.base(spark, sf, "conversations").groupBy("conv_id").agg(F.coalesce(last, F.lit("")).alias("final_text"))


@query("p1_inference_view", "SELECT concat('doc/', CAST(doc_id AS STRING)) AS trace_id, text AS goal FROM documents")
def inference(spark, sf):
    rows = docs(spark, sf).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("trace_id"), F.col("text").alias("goal"), F.col("source").alias("label"), F.col("lang").alias("oracle"))
    return K.inference_view(rows)


@query("p2_leakage_scan", """SELECT event_id AS trace_id, CASE event_id % 4 WHEN 0 THEN 'label' ELSE 'oracle' END AS name FROM events WHERE event_id % 4 < 2""")
def leakage(spark, sf):
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a":{"b":[1,{"label":'), F.col("props"), F.lit("}]}}"))).when(
        F.col("event_id") % 4 == 1, F.concat(F.lit('{"oracle":'), F.col("props"), F.lit(',"t":"the label"}'))).otherwise(F.concat(F.lit('{"t":"oracle \\"label\\": no","p":'), F.col("props"), F.lit("}")))
    return K.leakage(corpus.base(spark, sf, "events").select(F.col("event_id").alias("trace_id"), body.alias("body")), "body")


@query("f24_evidence_strings", """SELECT CAST(event_id AS STRING) AS trace_id, CASE v.i WHEN 0 THEN 'k' WHEN 1 THEN regexp_extract(props, '([0-9]+)', 1) WHEN 2 THEN 'update_record' ELSE event_type END AS text
FROM events, (VALUES (0), (1), (2), (3)) AS v(i)""")
def evidence(spark, sf):
    e = corpus.base(spark, sf, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.lit("tool_result").alias("type"), F.lit("update_record").alias("tool"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("arguments"), F.col("props").alias("data"))
    return K.evidence_strings(e)


@query("f25_verbatim_in_evidence", "SELECT CAST(event_id AS STRING) AS trace_id FROM events WHERE contains(event_type, 'click') OR regexp_extract(props, '([0-9]+)', 1) = '7'")
def verbatim(spark, sf):
    e = corpus.base(spark, sf, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.lit("tool_result").alias("type"), F.lit("u").alias("tool"), F.upper("event_type").alias("status"), F.lit(None).cast("string").alias("arguments"), F.col("props").alias("data"), "props")
    described = e.select("trace_id", F.when(F.get_json_object("props", "$.k") == "7", "7").otherwise("CLICK").alias("described_target"))
    return K.verbatim_in_evidence(K.evidence_strings(e), described)


# -- the rules detector -----------------------------------------------------------------

_RULES = """, s AS (SELECT trace_id, max_by(text, seq) FILTER (WHERE type = 'assistant_message') AS final_text, max(seq) FILTER (WHERE tool = 'update_record' AND type = 'assistant_tool_call') AS last_call,
min(seq) FILTER (WHERE tool = 'update_record' AND type = 'tool_result' AND status = 'ok') AS first_ok FROM trace_events GROUP BY trace_id),
r AS (SELECT e.trace_id, min(seq) AS seq, min_by(status, seq) AS status, arg_min_null(data, seq) AS data FROM trace_events e JOIN s ON e.trace_id = s.trace_id WHERE e.tool = 'update_record' AND e.type = 'tool_result' AND e.seq > s.last_call GROUP BY e.trace_id),
g AS (SELECT s.trace_id, lower(coalesce(final_text, '')) AS t, last_call IS NULL AS no_action_call, last_call IS NOT NULL AND r.seq IS NULL AS missing_result,
coalesce(r.status = 'error', false) AS error_status, r.seq IS NOT NULL AND (coalesce(r.status, '') = 'timeout' OR r.data IS NULL) AS null_result,
coalesce(r.status = 'ok' AND r.data IS NOT NULL AND substr(s.trace_id, 1, 1) < '5', false) AS parameter_mismatch, first_ok, r.seq AS latest FROM s LEFT JOIN r ON s.trace_id = r.trace_id),
f AS (SELECT *, (missing_result AND first_ok IS NOT NULL) OR coalesce((error_status OR null_result) AND first_ok < latest, false) AS stale,
regexp_matches(t, '\\b(done|all set|successfully|completed|taken care of|confirmed|has been|is now)\\b') AND NOT regexp_matches(t, '\\b(could not|did not|unable|failed|pending|which option|no change)\\b') AS claim,
regexp_matches(t, '\\b(could not|unable|failed|pending|queued)\\b') AS reports_failure FROM g)"""


def detected(spark, sf):
    events = corpus.view(spark, sf, "trace_events")
    # Half of the traces require a key the results never carry.
    tool = F.array(F.struct(F.lit("update_record").alias("name"), F.when(F.substring("trace_id", 1, 1) < "5", F.array(F.lit("k"), F.lit("unit"))).otherwise(F.array(F.lit("k"))).alias("required")),
                   F.struct(F.lit("get_record").alias("name"), F.array().cast("array<string>").alias("required")))
    traces = events.select("trace_id").distinct().select("trace_id", F.concat(F.lit("update "), "trace_id").alias("goal"), tool.alias("tool_schema"))
    return U.detect(events, traces)


@query("m1_text_markers", with_views("trace_events", _RULES + " SELECT trace_id, claim, reports_failure FROM f"))
def markers(spark, sf):
    return detected(spark, sf).select("trace_id", "claim", "reports_failure")


@query("m2_j11_j12_evidence_signals", with_views("trace_events", _RULES + " SELECT trace_id, no_action_call, missing_result, error_status, null_result, parameter_mismatch, stale, false AS noop, false AS entity_mismatch FROM f"))
def signals(spark, sf):
    return detected(spark, sf).select("trace_id", *U.WEIGHTS)


@query("m3_rules_score", with_views("trace_events", _RULES + """, z AS (SELECT *, CASE WHEN claim THEN least(9.9e-1, 1.5e-1 + CASE WHEN no_action_call THEN 6e-1 ELSE 0e0 END + CASE WHEN missing_result THEN 5.5e-1 ELSE 0e0 END + CASE WHEN error_status THEN 5.5e-1 ELSE 0e0 END
+ CASE WHEN null_result THEN 5e-1 ELSE 0e0 END + CASE WHEN parameter_mismatch THEN 4.5e-1 ELSE 0e0 END + CASE WHEN stale THEN 3e-1 ELSE 0e0 END) ELSE 2e-2 END AS s FROM f)
SELECT trace_id, round(s, 6) AS primary_score, CASE WHEN NOT claim AND reports_failure THEN 'reported_failure_or_uncertainty' WHEN NOT claim THEN 'no_success_claim' WHEN s >= 5e-1 THEN 'unsupported_success' ELSE 'supported_success' END AS predicted_label,
round(abs(s - 5e-1) * 2, 6) AS confidence, round((1e0 - s) * CASE WHEN claim THEN 8e-1 ELSE 1e-1 END, 6) AS p_supported, CASE WHEN s >= 5e-1 THEN 'flag' ELSE 'pass' END AS decision FROM z"""))
def rules_score(spark, sf):
    return detected(spark, sf).select("trace_id", "primary_score", "predicted_label", "confidence", F.try_element_at("probabilities", F.lit("supported_success")).alias("p_supported"), "decision")


@query("p10_action_tool_filter", with_views("trace_events", "SELECT DISTINCT tool, NOT starts_with(tool, 'get_') AS is_action FROM trace_events WHERE tool IS NOT NULL"))
def action_tools(spark, sf):
    tools = corpus.view(spark, sf, "trace_events").where("tool IS NOT NULL").select("tool").distinct()
    return tools.withColumn("is_action", ~U.is_read_only(F.col("tool")))


# -- text --------------------------------------------------------------------------------


@query("f1_f2_canonical_digest", "SELECT event_id, sha256(concat('{\"a\":', regexp_extract(props, '([0-9]+)', 1), ',\"b\":\"é/\"}')) AS digest FROM events")
def digest(spark, sf):
    body = F.concat(F.lit('{ "b" : "é/", "a" : '), F.get_json_object("props", "$.k"), F.lit("}"))
    return corpus.base(spark, sf, "events").select("event_id", X.sha256_text(X.canonical_json(body)).alias("digest"))


@query("f4_content_id", "SELECT doc_id, substr(sha256(concat(text, ':7')), 1, 16) AS content_id FROM documents")
def content_id(spark, sf):
    return docs(spark, sf).select("doc_id", X.content_id(F.col("text"), 7).alias("content_id"))


@query("f3_table_fingerprint", """WITH h AS (SELECT sha256(concat('{"doc_id":', CAST(doc_id AS STRING), ',"quality":', CAST(quality AS STRING), ',"toxic":', CAST(toxic AS STRING), '}')) AS x FROM labels),
b AS (SELECT CAST(concat('0x', substr(x, 57, 8)) AS BIGINT) % 4096 AS bucket, count(*) AS n, """ + ", ".join(f"CAST(sum(CAST(concat('0x', substr(x, {1 + 8 * i}, 8)) AS BIGINT)) AS STRING) AS l{i}" for i in range(4)) + """ FROM h GROUP BY 1)
SELECT sha256(string_agg(concat_ws(':', CAST(bucket AS STRING), CAST(n AS STRING), l0, l1, l2, l3), '|' ORDER BY concat_ws(':', CAST(bucket AS STRING), CAST(n AS STRING), l0, l1, l2, l3))) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM b""")
def fingerprint(spark, sf):
    return X.table_fingerprint(corpus.base(spark, sf, "labels"))


@query("f10_redact_text")
def redact(spark, sf):
    return docs(spark, sf).select("doc_id", X.redact_text(F.col("text")).alias("text"))


@query("f11_redact_json")
def redact_json(spark, sf):
    rows = corpus.base(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("token"), F.struct("text", F.col("conv_id").cast("string").alias("trace_id")).alias("body"))).alias("raw"))
    return rows.select("conv_id", "turn", X.redact_json("raw", F.array().cast("array<string>")).alias("clean"))


@query("f12_contains_secret", "SELECT doc_id, contains(text, concat('Eauouon.', chr(10))) OR contains(text, 'the that') AS hit FROM documents")
def secret(spark, sf):
    rows = X.with_secrets(docs(spark, sf), X.secret_table(spark, ["Eauouon.\n", "the that"]))
    return rows.select("doc_id", X.contains_secret(F.col("text"), F.col("secrets")).alias("hit"))


@query("f22_f23_render", "SELECT doc_id, length(text) + length(source) + 30 AS feature_chars FROM documents")
def render(spark, sf):
    none = F.lit(None).cast("string")
    event = F.array(F.struct(F.lit("assistant_message").alias("type"), none.alias("tool"), none.alias("arguments"), none.alias("status"), none.alias("data"), F.col("text").alias("text")))
    tools = F.array(F.struct(F.lit("tool_a").alias("name")))
    return docs(spark, sf).select("doc_id", F.length(X.render_features(F.col("source"), tools, event)).alias("feature_chars")).withColumn("feature_chars", F.col("feature_chars") - F.lit(len("goal: \ntools: tool_a\nassistant ") - 30))


@query("m4_word_tfidf", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(list_zip(ws[1:len(ws)-1], ws[2:]), lambda p: concat(p[1], ' ', p[2])))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1e0 AS idf FROM c GROUP BY term HAVING count(*) >= 2),
x AS (SELECT doc_id, (1 + ln(tf)) * idf AS raw FROM c JOIN v ON c.term = v.term), n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS len, sum(raw) AS total, max(raw) AS top, count(*) AS terms FROM x GROUP BY doc_id)
SELECT doc_id, terms, round(total / len, 6) AS total_weight, round(top / len, 6) AS top_weight FROM n""")
def word_tfidf(spark, sf):
    return W.tfidf_summary(docs(spark, sf), "doc_id", "text")


@query("m5_char_tfidf", """WITH w AS (SELECT doc_id, concat(' ', unnest(regexp_split_to_array(lower(text), '\\s+')), ' ') AS w FROM documents), f AS (SELECT doc_id, w, count(*) AS k FROM w WHERE w <> '  ' GROUP BY ALL),
g AS (SELECT doc_id, k, substr(w, CAST(i.i AS BIGINT), n.n) AS term FROM f, (VALUES (3), (4), (5)) AS n(n), LATERAL (SELECT unnest(range(1, length(w) - n.n + 2)) AS i) AS i),
c AS (SELECT doc_id, term, sum(k) AS tf FROM g GROUP BY ALL), v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1e0 AS idf FROM c GROUP BY term HAVING count(*) >= 2),
x AS (SELECT doc_id, (1 + ln(tf)) * idf AS raw FROM c JOIN v ON c.term = v.term), n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS len, sum(raw) AS total, max(raw) AS top, count(*) AS terms FROM x GROUP BY doc_id)
SELECT doc_id, terms, round(total / len, 6) AS total_weight, round(top / len, 6) AS top_weight FROM n""")
def char_tfidf(spark, sf):
    return W.tfidf_summary(docs(spark, sf), "doc_id", "text", chars=True)


# -- context budget ------------------------------------------------------------------------


@query("f18_state_char_budget", "SELECT doc_id, greatest(1000, 80000 - n_chars) AS budget FROM documents")
def char_budget(spark, sf):
    return docs(spark, sf).select("doc_id", S.state_char_budget(F.col("n_chars")).alias("budget"))


_STEPS = [(n, i, h, t) for n in range(17) for i, (h, t) in enumerate(B.window_steps(n))]
_PLAN = f"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x) + 20) AS ls FROM documents), n AS (SELECT *, len(ls) AS n, list_sum(ls) AS whole FROM d),
st AS (SELECT * FROM (VALUES {', '.join(str(s) for s in _STEPS)}) AS v(size, step, h, t)),
c AS (SELECT doc_id, step, h, t, greatest(n - h - t, 0) AS dropped, 100 + CASE WHEN n - h - t > 0 THEN coalesce(list_sum(ls[1:h]), 0) + CASE WHEN t > 0 THEN coalesce(list_sum(ls[n-t+1:n]), 0) ELSE 0 END + 50 ELSE whole END AS chars FROM n JOIN st ON st.size = least(n.n, 16)),
o AS (SELECT doc_id, coalesce(min(step) FILTER (WHERE chars <= 1500), max(step)) AS step FROM c GROUP BY doc_id)"""


@query("f21_elision_plan", _PLAN + " SELECT c.doc_id, h AS head, t AS tail, CAST(dropped AS INT) AS dropped, CAST(chars AS BIGINT) AS chars FROM c JOIN o ON c.doc_id = o.doc_id AND c.step = o.step")
def elision(spark, sf):
    lens = F.transform(F.split("text", "\n"), lambda x: (F.length(x) + 20).cast("bigint"))
    plan = B.elision_plan(lens, F.lit(100).cast("bigint"), F.lit(1500).cast("bigint"), lambda dropped: F.lit(50))
    return docs(spark, sf).select("doc_id", plan.alias("p")).select("doc_id", "p.*")


def doc_traces(spark, sf):
    none = F.lit(None).cast("string")
    events = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("seq"), F.lit("tool_result").alias("type"), F.lit("t").alias("tool"), none.alias("arguments"), F.lit("ok").alias("status"), F.to_json(F.struct(x.alias("v"))).alias("data"), none.alias("text")))
    tools = F.array(F.struct(F.lit("t").alias("name"), F.array().cast("array<string>").alias("required")))
    return docs(spark, sf).select("doc_id", "source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("trace_id"), F.lit("goal").alias("goal"), tools.alias("tool_schema"), events.alias("events"))


@query("f19_f20_f21_s11_fit_events")
def fit_events(spark, sf):
    return B.truncation_rows(B.fit_events(spread(doc_traces(spark, sf)), F.lit(3000), F.lit("rule")))


_TRUNCATED = """WITH r AS (SELECT source, doc_id % 5 AS dropped, doc_id % 3 AS shortened, doc_id % 7 <> 0 AS fits FROM documents{where})
SELECT source, count(*) AS truncated_traces, CAST(sum(dropped) AS BIGINT) AS dropped_events, CAST(sum(shortened) AS BIGINT) AS shortened_payloads, count(*) FILTER (WHERE NOT fits) AS did_not_fit, 'middle-elision-v1' AS rule FROM r GROUP BY source"""


def truncation_of(rows):
    rows = rows.select("source", (F.col("doc_id") % 5).alias("dropped_events"), (F.col("doc_id") % 3).alias("shortened_payloads"), (F.col("doc_id") % 7 != 0).alias("fits"), F.lit(B.RULE).alias("rule"))
    return B.truncation_summary(rows, ("source",))


@query("a25_truncation_summary", _TRUNCATED.format(where=" WHERE n_chars > 1000"))
def truncation(spark, sf):
    return truncation_of(docs(spark, sf).where("n_chars > 1000"))


@query("a25_truncation_summary_whole", _TRUNCATED.format(where=""))
def truncation_whole(spark, sf):
    return truncation_of(docs(spark, sf))


@query("a48_over_budget_count", "SELECT lang, count(*) FILTER (WHERE length(text) > 2000) AS over_budget, count(*) AS n FROM documents GROUP BY lang")
def over_budget(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(B.over_budget_count(F.length("text"), F.lit(2000)).alias("over_budget"), F.count(F.lit(1)).alias("n"))


_PROJECT = """WITH t AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY source),
k AS (SELECT *, CAST(round_even(chars / 2.5e0, 0) AS BIGINT) + 300 * n AS high, CAST(round_even(chars / 4e0, 0) AS BIGINT) + 300 * n AS low, 800 * n AS outs FROM t)"""


def projected(spark, sf):
    t = docs(spark, sf).groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    tokens = t.withColumns({"high": S.project_tokens(F.col("chars"), 2.5, 300, F.col("n")), "low": S.project_tokens(F.col("chars"), 4.0, 300, F.col("n")), "outs": F.col("n") * 800})
    usd = lambda c: S.cost_usd(F.col(c), F.col("outs"), F.lit(0.042), F.lit(0.5), F.lit(True))
    return tokens.withColumns({"usd_low": usd("low"), "usd_high": usd("high")})


@query("a47_f15_projection_totals", _PROJECT + " SELECT source, chars, n, high, low, outs, round((low * 4.2e-2 + outs * 5e-1) / 1e6, 6) AS usd_low, round((high * 4.2e-2 + outs * 5e-1) / 1e6, 6) AS usd_high FROM k")
def projection(spark, sf):
    return projected(spark, sf)


@query("p14_spend_gate", _PROJECT + " SELECT source, round((high * 4.2e-2 + outs * 5e-1) / 1e6 * 7.5e-1, 6) AS top FROM k WHERE (high * 4.2e-2 + outs * 5e-1) / 1e6 * 7.5e-1 > 1e-2")
def spend_gate(spark, sf):
    return projected(spark, sf).select("source", S.fx(F.col("usd_high"), 0.75).alias("top")).where("top > 0.01")


@query("f16_calibrated_projection", """WITH m AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, min_by(length(text), doc_id) AS one, min_by(length(text) // 3, doc_id) AS tok FROM documents GROUP BY source)
SELECT source, CASE WHEN one > 0 AND tok > 0 THEN CAST(round_even(chars / (CAST(one AS DOUBLE) / tok), 0) AS BIGINT) END AS tokens FROM m""")
def calibrated(spark, sf):
    n = F.length("text")
    m = docs(spark, sf).groupBy("source").agg(F.sum(n).alias("chars"), F.min_by(n, "doc_id").alias("one"), F.min_by(F.floor(n / 3), "doc_id").alias("tok"))
    ratio = F.col("one").cast("double") / F.col("tok")
    return m.select("source", F.when((F.col("one") > 0) & (F.col("tok") > 0), F.bround(F.col("chars") / ratio, 0).cast("bigint")).alias("tokens"))


@query("f31_backoff_delay", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_partkey % 5 = 0 THEN greatest(0e0, l_quantity - 10) ELSE least(5e-1 * pow(2e0, l_linenumber - 1), 5e0) * (1e0 - 2.5e-1 * l_discount) END, 6) AS delay FROM lineitem")
def backoff(spark, sf):
    rows = corpus.base(spark, sf, "lineitem")
    delay = S.backoff_delay(F.col("l_linenumber"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") - 10), F.col("l_discount"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", delay.alias("delay"))


# -- requests and replies --------------------------------------------------------------------


def reply_rows(spark, sf):
    """A structured reply per prediction, every seventh one broken in a known way."""
    p = corpus.view(spark, sf, "predictions").where("primary_score IS NOT NULL")
    probability = F.concat(F.lit('{"supported_success":'), (1 - F.col("primary_score")).cast("string"), F.lit(',"unsupported_success":'), F.col("primary_score").cast("string"), F.lit("}"))
    kind = F.col("arrival") % 7
    choice = F.when(kind == 2, "other").otherwise(F.col("predicted_label"))
    probability = F.when(kind == 3, F.lit('{"zzz":1}')).otherwise(probability)
    subs = F.when(kind == 4, F.lit('"has_success_claim":{"noul":1}')).otherwise(F.lit('"has_success_claim":{"noul":1},"tool_evidence_supports_claim":{"noul":0.5},"needs_review":{"noul":0.25}'))
    body = F.concat(F.lit('{"answers":{"verdict":{"choice":"'), choice, F.lit('","probabilities":'), probability, F.lit("},"), subs, F.lit('},"usage":{"input_tokens":'), F.col("input_tokens").cast("string"), F.lit(',"output_tokens":2},"model":"m"}'))
    return p.select("trace_id", "provider", "arrival", F.when(kind == 1, "oops").otherwise(body).alias("body"))


_KIND = "CASE arrival % 7 WHEN 1 THEN 'ParseFailureError: response has no ''answers'' object' WHEN 2 THEN 'ParseFailureError: verdict ''choice'' is not one of the four labels' WHEN 3 THEN 'ParseFailureError: verdict returned an unknown option zzz' WHEN 4 THEN 'ParseFailureError: response has no ''tool_evidence_supports_claim'' answer' END"


@query("f27_parse_structured_reply", with_views("predictions", f"SELECT trace_id, provider, arrival, {_KIND} AS error, CASE WHEN {_KIND} IS NULL THEN round(primary_score, 6) END AS primary_score, CASE WHEN {_KIND} IS NULL THEN input_tokens END AS input_tokens FROM predictions WHERE primary_score IS NOT NULL"))
def parse_reply(spark, sf):
    return Y.parse_structured(reply_rows(spark, sf)).select("trace_id", "provider", "arrival", "error", "primary_score", "input_tokens")


@query("f28_parse_chat_reply", with_views("predictions", """SELECT trace_id, provider, arrival, CASE arrival % 5 WHEN 1 THEN 'ParseFailureError: finish_reason is ''length'': the answer was cut off' WHEN 2 THEN 'ParseFailureError: message content is not JSON' WHEN 3 THEN 'ParseFailureError: needs_review is outside [0, 1]' END AS error,
CASE WHEN arrival % 5 IN (0, 4) THEN round(primary_score, 6) END AS primary_score FROM predictions WHERE primary_score IS NOT NULL"""))
def parse_chat(spark, sf):
    p = corpus.view(spark, sf, "predictions").where("primary_score IS NOT NULL")
    kind = F.col("arrival") % 5
    inner = F.concat(F.lit('{"verdict":{"choice":"'), F.col("predicted_label"), F.lit('","confidence":0.5,"probabilities":{"supported_success":0,"reported_failure_or_uncertainty":0,"no_success_claim":0,"unsupported_success":'), F.col("primary_score").cast("string"),
        F.lit('}},"has_success_claim":1,"tool_evidence_supports_claim":0,"needs_review":'), F.when(kind == 3, "1.5").otherwise("0.5"), F.lit("}"))
    body = F.to_json(F.struct(F.array(F.struct(F.when(kind == 1, "length").otherwise("stop").alias("finish_reason"), F.struct(F.when(kind == 2, "nope {").otherwise(inner).alias("content")).alias("message"))).alias("choices"), F.struct(F.col("input_tokens").alias("prompt_tokens"), F.lit(3).alias("completion_tokens")).alias("usage")))
    return Y.parse_chat(p.select("trace_id", "provider", "arrival", body.alias("body"))).select("trace_id", "provider", "arrival", "error", "primary_score")


@query("f29_reply_error_class", with_views("predictions", "SELECT trace_id, provider, arrival, CASE arrival % 6 WHEN 0 THEN 'no response' WHEN 1 THEN 'ParseFailureError: response body is not JSON' WHEN 2 THEN 'HTTP 429' WHEN 3 THEN 'gave up' END AS error FROM predictions"))
def error_class(spark, sf):
    k = F.col("arrival") % 6
    rows = corpus.view(spark, sf, "predictions")
    error = Y.reply_error(F.when(k == 0, None).when(k.isin(2, 3), 429).otherwise(200), F.when(k == 1, "<html>").otherwise('{"a":1}'), F.when(k == 3, "gave up"), F.lit(None).cast("string"))
    return rows.select("trace_id", "provider", "arrival", error.alias("error"))


def refusals(spark, sf):
    k = F.col("arrival") % 4
    code = F.when(k == 0, "unsupported_value").when(k == 1, "unsupported_parameter").otherwise("other")
    param = F.when(F.col("arrival") % 3 == 0, "temperature").when(F.col("arrival") % 3 == 1, "top_p").otherwise("seed")
    body = F.to_json(F.struct(F.struct(code.alias("code"), param.alias("param"), F.lit("no").alias("message")).alias("error")))
    return corpus.view(spark, sf, "predictions").select("provider", "trace_id", "arrival", Y.unsupported_parameter(body).alias("refused")).where("refused IS NOT NULL")


@query("f30_unsupported_parameter", with_views("predictions", "SELECT provider, trace_id, arrival, CASE arrival % 3 WHEN 0 THEN 'temperature' ELSE 'top_p' END AS param, CASE arrival % 4 WHEN 0 THEN 'unsupported_value' ELSE 'unsupported_parameter' END AS code FROM predictions WHERE arrival % 3 < 2 AND arrival % 4 < 2"))
def unsupported(spark, sf):
    return refusals(spark, sf).select("provider", "trace_id", "arrival", "refused.param", "refused.code")


@query("a26_deviation_summary", with_views("predictions", "SELECT provider, CASE arrival % 3 WHEN 0 THEN 'temperature' ELSE 'top_p' END AS parameter, count(*) AS occurrences, min_by(trace_id, arrival) AS first_seen_trace_id, min(CASE arrival % 4 WHEN 0 THEN 'unsupported_value' ELSE 'unsupported_parameter' END) AS error_code FROM predictions WHERE arrival % 3 < 2 AND arrival % 4 < 2 GROUP BY ALL"))
def deviations(spark, sf):
    return Y.deviation_summary(refusals(spark, sf), "arrival")


@query("f26_judge_request")
def judge_request(spark, sf):
    t = doc_traces(spark, sf)
    state = Y.state_json(F.col("goal"), F.col("tool_schema"), F.col("events"), F.lit("rule"))
    return t.select("trace_id", Y.structured_request(F.lit("m"), state, F.lit("{}")).alias("body"))
