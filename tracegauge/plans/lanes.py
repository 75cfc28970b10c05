"""Queries over lanes, pairs, splits, runs and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import faults as L, joins as J, operational as O, ranking as R, runs as N, sets as U, verify as V
from ..operators.running import running_totals
from ..schemas import POSITIVE_LABEL
from . import corpus
from .corpus import FREE, PROVIDERS, SCORED, with_views
from .registry import query
from .scoring import ARM, points, priced, scored, threshold

LANE, RULES, STRONG, GENERAL = "typed", "rules", "boosted", "general"
RIVALS = (RULES, STRONG, GENERAL)
FAULT, CONTROL = "fault_1", "fault_2"
FX = 0.75


def truth(spark, sf):
    return corpus.view(spark, sf, "truth")


def table(spark, sf):
    lanes = L.lanes_by_trace(points(spark, sf), threshold(), PROVIDERS, FREE)
    return L.lane_table(truth(spark, sf), lanes)


def flags(spark, sf):
    return J.lane_flags(points(spark, sf), threshold())


def positives(spark, sf):
    return truth(spark, sf).where(F.col("label") == POSITIVE_LABEL).select("trace_id")


# Check-side lane table, pivoted with plain CASE sums.
def _lane_sql(names=PROVIDERS):
    cols = []
    for p in names:
        cols.append(f"coalesce(bool_or(p.provider = '{p}' AND p.primary_score IS NOT NULL), false) AS {p}_s")
        cols.append(f"coalesce(bool_or(p.provider = '{p}' AND p.primary_score >= h.threshold), false) AS {p}_f")
    cols.append("coalesce(bool_or(p.provider IN ('rules','linear','boosted') AND p.primary_score IS NOT NULL), false) AS free_union_s")
    cols.append("coalesce(bool_or(p.provider IN ('rules','linear','boosted') AND p.primary_score >= h.threshold), false) AS free_union_f")
    return (
        ", lanes AS (SELECT t.trace_id, t.label, t.fault_type, " + ", ".join(cols)
        + " FROM truth t LEFT JOIN points p ON t.trace_id = p.trace_id LEFT JOIN thresholds h ON p.provider = h.provider GROUP BY ALL)"
    )


LANES = "truth predictions thresholds zero_repeat points"
RATE = "round(CAST(count(*) FILTER (WHERE {p}_f) AS DOUBLE) / nullif(count(*) FILTER (WHERE {p}_s), 0), 6) AS {p}_rate"
COUNTS = "count(*) FILTER (WHERE {p}_f) AS {p}_flagged, count(*) FILTER (WHERE {p}_s) AS {p}_scored"
ALL = (*PROVIDERS, "free_union")
RAW = "CAST(count(*) FILTER (WHERE {p}_f) AS DOUBLE) / nullif(count(*) FILTER (WHERE {p}_s), 0)"
GAPS = ", ".join(f"round({RAW.format(p=LANE)} - {RAW.format(p=r)}, 6) AS gap_vs_{r}" for r in RIVALS)
CELL = ", ".join(f"{COUNTS.format(p=p)}, {RATE.format(p=p)}" for p in ALL) + ", " + GAPS


@query("a13_per_fault_matrix", with_views(SCORED, """SELECT provider, label, fault_type, count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS flagged,
round(avg(score), 6) AS mean_score, round(count(*) FILTER (WHERE score >= threshold) / CAST(count(*) AS DOUBLE), 6) AS flag_rate FROM scored GROUP BY ALL"""))
def per_fault(spark, sf):
    return L.per_fault_matrix(scored(spark, sf, "", "fault_type"), ARM, F.col("threshold"))


@query("a46_fault_heatmap", with_views(SCORED, "SELECT concat(label, '/', fault_type) AS cell, " + ", ".join(
    f"round(count(*) FILTER (WHERE provider = '{p}' AND score >= threshold) / CAST(nullif(count(*) FILTER (WHERE provider = '{p}'), 0) AS DOUBLE), 6) AS {p}" for p in PROVIDERS)
    + " FROM scored GROUP BY ALL"))
def heatmap(spark, sf):
    return L.fault_heatmap(L.per_fault_matrix(scored(spark, sf, "", "fault_type"), ARM, F.col("threshold")), PROVIDERS)


@query("a15_cell_rates", with_views(LANES, _lane_sql() + f" SELECT label, fault_type, count(*) AS n, {CELL} FROM lanes GROUP BY label, fault_type"))
def cells(spark, sf):
    return L.cell_rates(table(spark, sf), PROVIDERS, LANE, RIVALS)


GROUPS = _lane_sql() + f""", g AS (SELECT fault_type, count(*) AS n, {CELL} FROM lanes WHERE label = 'unsupported_success' GROUP BY fault_type),
pc AS (SELECT q.*, CASE WHEN q.input_tokens IS NOT NULL AND r.verified AND r.in_rate IS NOT NULL AND r.out_rate IS NOT NULL
       THEN (q.input_tokens * r.in_rate + q.output_tokens * r.out_rate) / 1e6 END AS cost_usd FROM points q LEFT JOIN prices r ON q.model_id = r.model_id),
m AS (SELECT t.fault_type, round(avg(latency_ms), 6) AS mean_latency_ms, round(coalesce(sum(cost_usd), 0e0), 6) AS cost_usd FROM pc JOIN truth t ON pc.trace_id = t.trace_id
      WHERE pc.provider = 'typed' AND t.label = 'unsupported_success' GROUP BY t.fault_type)"""


def groups(spark, sf):
    rows = O.with_cost(J.price_join(points(spark, sf), corpus.view(spark, sf, "prices")))
    return L.detection_groups(table(spark, sf), rows, PROVIDERS, LANE, RIVALS)


@query("a14_detection_groups", with_views(LANES + " prices", GROUPS + " SELECT g.*, m.mean_latency_ms, coalesce(m.cost_usd, 0e0) AS cost_usd FROM g LEFT JOIN m ON g.fault_type = m.fault_type"))
def detection(spark, sf):
    return groups(spark, sf)


@query("a16_no_added_value", with_views(LANES, _lane_sql() + f""", g AS (SELECT fault_type, count(*) AS n, {CELL} FROM lanes WHERE label = 'unsupported_success' GROUP BY fault_type)
SELECT fault_type, gap_vs_boosted FROM g WHERE (rules_rate = 1 AND rules_scored > 0) OR (boosted_rate = 1 AND boosted_scored > 0) OR (gap_vs_boosted <= 0 AND boosted_scored > 0)"""))
def no_value(spark, sf):
    return L.no_added_value(groups(spark, sf), (RULES, STRONG), STRONG).select("fault_type", "gap_vs_boosted")


@query("a17_lane_summary", with_views(LANES, _lane_sql() + " UNION ALL ".join(
    f" SELECT '{p}' AS lane, count(*) FILTER (WHERE {p}_f) AS flagged, count(*) FILTER (WHERE {p}_s) AS scored, round({RAW.format(p=p)}, 6) AS rate FROM lanes WHERE label = 'unsupported_success'" for p in ALL)))
def lanes(spark, sf):
    return L.lane_summary(table(spark, sf), ALL)


@query("a18_control_separation", with_views(SCORED, """, r AS (SELECT provider, count(*) FILTER (WHERE fault_type = 'fault_1') AS fault_n, count(*) FILTER (WHERE fault_type = 'fault_2') AS control_n,
CAST(count(*) FILTER (WHERE fault_type = 'fault_1' AND score >= threshold) AS DOUBLE) / nullif(count(*) FILTER (WHERE fault_type = 'fault_1'), 0) AS fr,
CAST(count(*) FILTER (WHERE fault_type = 'fault_2' AND score >= threshold) AS DOUBLE) / nullif(count(*) FILTER (WHERE fault_type = 'fault_2'), 0) AS cr FROM scored GROUP BY provider)
SELECT provider, fault_n, control_n, round(fr, 6) AS fault_rate, round(cr, 6) AS control_rate, round(fr - cr, 6) AS separation FROM r"""))
def separation(spark, sf):
    return L.control_separation(scored(spark, sf, "", "fault_type"), ARM, F.col("threshold"), FAULT, CONTROL)


def _n(cond):
    return f"count(*) FILTER (WHERE label = 'unsupported_success' AND {cond})"


@query("a41_kpis", with_views(LANES + " prices priced", _lane_sql() + f"""
SELECT count(*) AS traces_total, {_n('true')} AS positives_total, {_n('typed_f')} AS caught_with, {_n('typed_s')} AS caught_with_scored, {_n('rules_f')} AS caught_rules,
{_n('boosted_f')} AS caught_strong, {_n('free_union_f')} AS caught_free_union, {_n('rules_s AND NOT rules_f AND typed_f')} AS only_vs_rules,
{_n('boosted_s AND NOT boosted_f AND typed_f')} AS only_vs_strong, {_n('NOT free_union_f AND typed_f')} AS only_vs_union,
{_n('rules_s AND NOT rules_f')} AS rules_misses, {_n('boosted_s AND NOT boosted_f')} AS strong_misses, {_n('NOT free_union_f')} AS union_misses,
(SELECT count(DISTINCT trace_id) FROM priced WHERE provider = 'typed') AS traces_evaluated, (SELECT count(*) FROM priced WHERE provider = 'typed') AS predictions_written,
(SELECT round(sum(cost_usd), 6) FROM priced WHERE provider = 'typed') AS spend_usd FROM lanes"""))
def kpis(spark, sf):
    return L.kpis(table(spark, sf), priced(spark, sf), LANE, RULES, STRONG, FREE)


@query("j7_any_lane_flags", with_views(LANES, """SELECT p.trace_id, bool_or(primary_score IS NOT NULL) AS is_scored, coalesce(bool_or(primary_score >= threshold), false) AS flagged
FROM points p JOIN thresholds h ON p.provider = h.provider WHERE p.provider IN ('rules','linear','boosted') GROUP BY p.trace_id"""))
def any_lane(spark, sf):
    return J.any_lane(flags(spark, sf), FREE)


@query("j8_missed_by_lane", with_views(LANES, _lane_sql() + " SELECT trace_id FROM lanes WHERE label = 'unsupported_success' AND general_s AND NOT general_f"))
def missed_lane(spark, sf):
    return J.missed_by_lane(positives(spark, sf), flags(spark, sf), GENERAL)


@query("j9_missed_by_all", with_views(LANES, _lane_sql() + " SELECT trace_id FROM lanes WHERE label = 'unsupported_success' AND NOT free_union_f"))
def missed_all(spark, sf):
    return J.missed_by_all(positives(spark, sf), flags(spark, sf), FREE)


@query("j10_flagged_only_by", with_views(LANES, _lane_sql() + " SELECT count(*) FILTER (WHERE typed_f) AS flagged, count(*) AS scored FROM lanes WHERE label = 'unsupported_success' AND NOT free_union_f AND typed_s"))
def only_by(spark, sf):
    f = flags(spark, sf)
    return J.flagged_only_by(J.missed_by_all(positives(spark, sf), f, FREE), f, LANE)


PAIR = """, a AS (SELECT trace_id, y, score FROM scored WHERE provider = 'typed'), b AS (SELECT trace_id, y, score FROM scored WHERE provider = 'general')"""


@query("j2_pair_arms", with_views(SCORED, PAIR + " SELECT a.trace_id, a.y, round(a.score, 6) AS score_a, round(b.score, 6) AS score_b FROM a JOIN b ON a.trace_id = b.trace_id"))
def pairs(spark, sf):
    return J.paired(J.pair_arms(scored(spark, sf, "ord"), LANE, GENERAL)).select("trace_id", "y", "score_a", "score_b")


@query("u4_symmetric_difference", with_views(SCORED, PAIR + " (SELECT trace_id FROM a EXCEPT SELECT trace_id FROM b) UNION ALL (SELECT trace_id FROM b EXCEPT SELECT trace_id FROM a)"))
def symmetric(spark, sf):
    return J.unpaired(J.pair_arms(scored(spark, sf, "ord"), LANE, GENERAL)).select("trace_id")


@query("o6_unpaired_head", with_views(SCORED, PAIR + ", u AS ((SELECT trace_id FROM a EXCEPT SELECT trace_id FROM b) UNION ALL (SELECT trace_id FROM b EXCEPT SELECT trace_id FROM a)) SELECT trace_id FROM u ORDER BY trace_id LIMIT 10"))
def unpaired_head(spark, sf):
    return J.unpaired(J.pair_arms(scored(spark, sf, "ord"), LANE, GENERAL)).select("trace_id").orderBy("trace_id").limit(10)


@query("a32_comparison_grid", with_views(SCORED, ", c AS (SELECT DISTINCT provider FROM scored) SELECT c.provider, d.provider AS target FROM c JOIN c d ON c.provider <> d.provider AND d.provider IN ('rules','boosted','general')"))
def grid(spark, sf):
    arms = scored(spark, sf, "").groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    return J.arm_pairs(arms, (RULES, STRONG, GENERAL)).select("provider", "target")


@query("p3_select_split", with_views("truth split_unit", "SELECT trace_id, template_family FROM truth WHERE template_family IN (SELECT template_family FROM split_unit WHERE split = 'test')"))
def select_split(spark, sf):
    return U.select_split(truth(spark, sf), corpus.view(spark, sf, "split_unit"), "test").select("trace_id", "template_family")


@query("j13_job_grid", with_views("truth", "SELECT trace_id, r AS repeat_no FROM truth, (VALUES (0), (1), (2)) AS v(r)"))
def job_grid(spark, sf):
    return J.job_grid(truth(spark, sf).select("trace_id"), 3)


@query("j17_f32_threshold_decision", with_views("predictions thresholds", """SELECT p.provider, p.trace_id, p.arrival, h.threshold,
CASE WHEN error IS NOT NULL THEN 'error' WHEN primary_score >= threshold THEN 'flag' ELSE 'pass' END AS decision FROM predictions p JOIN thresholds h ON p.provider = h.provider"""))
def decide(spark, sf):
    rows = corpus.view(spark, sf, "predictions").withColumn("threshold", threshold())
    return rows.select("provider", "trace_id", "arrival", "threshold",
                       S.decision(F.col("primary_score"), F.col("threshold"), F.col("error")).alias("decision"))


# -- sets and data checks ----------------------------------------------------------


@query("u1_split_overlap", with_views("truth", "SELECT domain AS template_family, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM truth GROUP BY domain HAVING count(DISTINCT split) > 1"))
def overlap(spark, sf):
    return U.split_overlap(truth(spark, sf).select(F.col("domain").alias("template_family"), "split").distinct())


@query("u2_uncovered_units", with_views("truth split_unit", "SELECT DISTINCT template_family FROM truth EXCEPT SELECT template_family FROM split_unit WHERE split <> 'test'"))
def uncovered(spark, sf):
    units = corpus.view(spark, sf, "split_unit").where("split <> 'test'")
    return U.uncovered_units(truth(spark, sf), units)


@query("u3_fault_gaps", with_views("truth", """, w AS (SELECT * FROM (VALUES ('fault_1'), ('fault_2'), ('fault_9')) AS v(fault)), s AS (SELECT DISTINCT fault_type AS fault FROM truth)
SELECT 'missing' AS problem, fault FROM (SELECT fault FROM w EXCEPT SELECT fault FROM s) UNION ALL SELECT 'foreign', fault FROM (SELECT fault FROM s EXCEPT SELECT fault FROM w)"""))
def fault_gaps(spark, sf):
    return U.fault_gaps(truth(spark, sf), ("fault_1", "fault_2", "fault_9"))


@query("u6_held_out_check", with_views("truth", "SELECT DISTINCT template_family FROM truth WHERE split = 'test' AND template_family IN (SELECT template_family FROM truth WHERE domain = 'dom_3')"))
def held_out(spark, sf):
    t = truth(spark, sf)
    return U.held_out_in_fit(t.where("domain = 'dom_3'"), t.where("split = 'test'").select("template_family").distinct())


@query("u7_m10_unseen_labels", with_views("truth", "SELECT DISTINCT label FROM truth WHERE split = 'validation' EXCEPT SELECT label FROM truth WHERE split = 'dev' AND fault_type = 'fault_1' AND label <> 'no_success_claim'"))
def unseen(spark, sf):
    t = truth(spark, sf)
    return U.unseen_labels(t.where("split = 'validation'"), t.where("split = 'dev' AND fault_type = 'fault_1' AND label <> 'no_success_claim'"))


@query("a42_label_diversity", with_views("truth", "SELECT template_family, min(label) AS label FROM truth GROUP BY template_family HAVING count(DISTINCT label) < 2"))
def diversity(spark, sf):
    return U.label_diversity(truth(spark, sf))


@query("a43_duplicate_ids", with_views("predictions", "SELECT trace_id, count(*) AS n FROM predictions GROUP BY trace_id HAVING count(*) > 1"))
def duplicates(spark, sf):
    return U.duplicate_ids(corpus.view(spark, sf, "predictions"))


_BALANCE = """SELECT 'label_balance' AS "check", '{sev}' AS severity, concat(v.name, '=', CAST(count(t.label) AS STRING)) AS detail
FROM (VALUES ('supported_success'), ('unsupported_success'), ('reported_failure_or_uncertainty'), ('no_success_claim')) AS v(name) LEFT JOIN truth t ON t.label = v.name
GROUP BY v.name HAVING count(t.label) <> (SELECT count(*) // 4 FROM truth)"""
_ONE = """SELECT 'one_label_unit', '{sev}', template_family FROM truth GROUP BY template_family HAVING count(DISTINCT label) < 2"""


@query("v1_validate_dataset", with_views("truth split_unit", _BALANCE.format(sev="note") + """ UNION ALL SELECT 'fault_missing', 'fail', 'fault_9' UNION ALL
SELECT DISTINCT 'fault_foreign', 'fail', fault_type FROM truth WHERE fault_type NOT IN ('fault_1','fault_2','fault_3','fault_9') UNION ALL
SELECT DISTINCT 'uncovered_unit', 'fail', template_family FROM truth WHERE split = 'test' UNION ALL """ + _ONE.format(sev="note")))
def validate(spark, sf):
    units = corpus.view(spark, sf, "split_unit").where("split <> 'test'")
    return V.validate_dataset(truth(spark, sf), units, ("fault_1", "fault_2", "fault_3", "fault_9"), real=True)


@query("v4_balance_contract", with_views("truth", _BALANCE.format(sev="fail") + " UNION ALL " + _ONE.format(sev="fail") + " UNION ALL SELECT 'fault_missing', 'fail', 'fault_9'"))
def contract(spark, sf):
    return V.balance_contract(truth(spark, sf), ("fault_1", "fault_2", "fault_3", "fault_4", "fault_5", "fault_9"))


# -- runs ----------------------------------------------------------------------------


def runs(spark, sf):
    return corpus.view(spark, sf, "runs")


_HEAD = """, m AS (SELECT * FROM runs WHERE status = 'complete'), p AS (SELECT * FROM runs WHERE concurrency <> 2)"""


@query("s9_run_headers", with_views("runs", _HEAD + """ SELECT coalesce(m.run_id, p.run_id) AS run_id, coalesce(m.provider, p.provider) AS provider, coalesce(m.split, p.split) AS split,
coalesce(m.created_utc, p.created_utc) AS created_utc, m.model_id, coalesce(p.status, 'complete') AS status FROM m FULL JOIN p ON m.run_id = p.run_id"""))
def headers(spark, sf):
    r = runs(spark, sf)
    cols = ["run_id", "provider", "split", "created_utc", "status"]
    return N.newest_first(N.run_headers(r.where("status = 'complete'").select(*cols, "model_id"), r.where("concurrency <> 2").select(*cols)))


@query("o2_newest_runs", with_views("runs", "SELECT run_id, created_utc FROM runs ORDER BY created_utc DESC, run_id DESC"))
def newest(spark, sf):
    return N.newest_first(runs(spark, sf)).select("run_id", "created_utc")


@query("w2_latest_run", with_views("runs", "SELECT provider, run_id, created_utc FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY created_utc DESC, run_id DESC) AS k FROM runs WHERE status = 'complete') q WHERE k = 1"))
def latest(spark, sf):
    return N.latest_run(runs(spark, sf).where("status = 'complete'")).select("provider", "run_id", "created_utc")


@query("p6_drop_stale_runs", with_views("runs", "SELECT run_id, split, dataset_id, split = 'test' AND dataset_id = 'ds1' AS kept FROM runs"))
def stale(spark, sf):
    r = runs(spark, sf).select("run_id", "split", "dataset_id")
    return N.current_runs(r, "test", "ds1").withColumn("kept", F.lit(True)).unionByName(
        N.stale_runs(r, "test", "ds1").withColumn("kept", F.lit(False)))


@query("u5_union_headers", with_views("runs", "SELECT run_id, split, CASE WHEN status = 'complete' THEN 'manifest' ELSE 'progress' END AS origin FROM runs WHERE status = 'complete' OR concurrency <> 2"))
def union_headers(spark, sf):
    r = runs(spark, sf)
    first = r.where("status = 'complete'").select("run_id", "split", F.lit("manifest").alias("origin"))
    second = r.where("concurrency <> 2").select("run_id", "split", F.lit("progress").alias("origin"))
    return N.union_headers(first, second)


@query("o7_sibling_arms", with_views("runs", "SELECT run_id, concurrency, created_utc FROM runs WHERE provider = 'typed' AND split = 'test'"))
def siblings(spark, sf):
    return N.sibling_arms(runs(spark, sf), LANE, "test").select("run_id", "concurrency", "created_utc")


@query("f37_parse_utc", with_views("runs", "SELECT run_id, epoch(CAST(replace(replace(updated_utc, 'T', ' '), 'Z', '') AS TIMESTAMP))::BIGINT AS seconds FROM runs"))
def parse_utc(spark, sf):
    return runs(spark, sf).select("run_id", S.parse_utc(F.col("updated_utc")).cast("bigint").alias("seconds"))


@query("w12_error_rate_guard", with_views("predictions", """, r AS (SELECT run_id, count(*) OVER w AS seen, count(error) OVER w AS failed FROM predictions WINDOW w AS (PARTITION BY run_id ORDER BY arrival ROWS UNBOUNDED PRECEDING))
SELECT run_id, min(seen) AS seen, min_by(failed, seen) AS failed FROM r WHERE seen >= 20 AND CAST(failed AS DOUBLE) / seen > 5e-2 GROUP BY run_id"""))
def guard(spark, sf):
    return N.error_rate_guard(corpus.view(spark, sf, "predictions"), ["run_id"])


@query("o3_recent_errors", with_views("predictions", "SELECT run_id, trace_id, error, arrival FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival DESC, trace_id DESC) AS k FROM predictions WHERE error IS NOT NULL) q WHERE k <= 8"))
def recent(spark, sf):
    return N.recent_errors(corpus.view(spark, sf, "predictions"), ["run_id"])


@query("o1_order_traces", with_views("truth", "SELECT trace_id, split, row_number() OVER (PARTITION BY split ORDER BY trace_id) AS place FROM truth"))
def order_traces(spark, sf):
    """The place of every trace in the order of ids; ids of one prefix are a cell, so no split is sorted in one task."""
    rows = truth(spark, sf).select("trace_id", "split", F.lit(1).cast("bigint").alias("one"))
    placed = running_totals(rows, ["split"], ["trace_id"], ["one"], [F.substring("trace_id", 1, n) for n in (8, 10)])
    return placed.select("trace_id", "split", (F.col("before_one") + 1).alias("place"))


@query("o1_o5_order_and_first_trace", with_views("truth", "SELECT split, min(trace_id) AS first_trace, count(*) AS n FROM truth GROUP BY split"))
def first_trace(spark, sf):
    return truth(spark, sf).groupBy("split").agg(F.min("trace_id").alias("first_trace"), F.count(F.lit(1)).alias("n"))


# -- money ---------------------------------------------------------------------------


@query("j3_f13_f14_price_join", with_views("prices predictions priced", "SELECT trace_id, provider, arrival, model_id, round(cost_usd, 6) AS cost_usd FROM priced"))
def price_join(spark, sf):
    return priced(spark, sf).select("trace_id", "provider", "arrival", "model_id", "cost_usd")


@query("j4_unknown_models", with_views("prices predictions", "SELECT DISTINCT model_id FROM predictions WHERE model_id NOT IN (SELECT model_id FROM prices WHERE verified)"))
def unknown_models(spark, sf):
    return J.unknown_models(corpus.view(spark, sf, "predictions"), corpus.view(spark, sf, "prices").where("verified"))


@query("s12_load_prices", with_views("prices", "SELECT model_id, round(in_rate, 6) AS in_rate, round(out_rate, 6) AS out_rate, verified FROM prices"))
def load_prices(spark, sf):
    from ..sources.dims import price_rows

    # Each price row travels as the JSON text a dated price file holds.
    files = corpus.view(spark, sf, "prices").select(
        F.concat(F.lit('{"manifest_date":"2026-09-20","currency":"USD","models":'),
                 F.to_json(F.create_map("model_id", F.struct(F.col("in_rate").alias("input_usd_per_mtok"), F.col("out_rate").alias("output_usd_per_mtok"), "verified"))),
                 F.lit("}")).alias("value"))
    return price_rows(files).select("model_id", "in_rate", "out_rate", "verified")


_MANIFEST = """, r AS (SELECT run_id, count(*) AS n_predictions, count(error) AS error_count, round(count(error) / CAST(count(*) AS DOUBLE), 6) AS error_rate,
count(*) FILTER (WHERE contains(error, 'ParseFailure')) AS parse_failure_count, CAST(sum(greatest(0, n_attempts - 1)) AS BIGINT) AS retry_count,
CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
round(CASE WHEN count(cost_usd) = count(*) THEN sum(cost_usd) END, 6) AS total_cost_usd FROM priced GROUP BY run_id)"""


@query("a21_run_manifest", with_views("prices predictions priced", _MANIFEST + " SELECT * FROM r"))
def manifest(spark, sf):
    return O.run_manifest(priced(spark, sf))


@query("a22_cost_block", with_views("runs prices predictions priced", """, r AS (SELECT run_id, sum(cost_usd) AS s, count(cost_usd) AS k, count(*) AS n, sum(input_tokens) AS ti, sum(output_tokens) AS tk FROM priced GROUP BY run_id),
b AS (SELECT u.run_id, u.provider, u.split, coalesce(s, 0e0) AS spend, k, n, ti, tk, CASE WHEN k = n THEN s END AS done FROM runs u JOIN r ON u.run_id = r.run_id)
SELECT run_id, provider, split, round(spend, 6) AS spend_usd, round(spend * 7.5e-1, 6) AS spend_converted,
round(coalesce(sum(done) OVER w, 0e0) - coalesce(done, 0e0) + spend, 6) AS sweep_spend_usd,
CAST(coalesce(sum(CASE WHEN done IS NOT NULL THEN n END) OVER w, 0) - CASE WHEN done IS NOT NULL THEN n ELSE 0 END + k AS BIGINT) AS sweep_requests,
k AS n_priced, n - k AS n_unpriced, round(spend / nullif(k, 0), 6) AS cost_per_request_usd, round(spend / nullif(k, 0) * 1e3, 6) AS cost_per_1000_usd,
CAST(ti AS BIGINT) AS input_tokens, CAST(tk AS BIGINT) AS output_tokens FROM b WINDOW w AS (PARTITION BY provider, split)"""))
def cost_block(spark, sf):
    return O.cost_block(priced(spark, sf), runs(spark, sf), FX)


@query("a23_f17_cost_per_1000", with_views("prices predictions priced", "SELECT provider, round(avg(cost_usd) * 1e3, 6) AS cost_per_1000_usd, round(avg(cost_usd) * 1e3 * 7.5e-1, 6) AS cost_per_1000_converted FROM priced GROUP BY provider"))
def per_1000(spark, sf):
    return O.cost_per_1000(priced(spark, sf), ARM, FX)


@query("a24_speed_by_arm", with_views("runs predictions", """, r AS (SELECT run_id, count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, avg(latency_ms) AS m FROM predictions GROUP BY run_id),
w AS (SELECT *, CASE WHEN status = 'complete' THEN CAST(epoch(CAST(replace(replace(updated_utc, 'T', ' '), 'Z', '') AS TIMESTAMP)) - epoch(CAST(replace(replace(created_utc, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS DOUBLE) END AS s FROM runs)
SELECT w.run_id, provider, concurrency, status, coalesce(n, 0) AS n, round(coalesce(p50, 0e0), 6) AS p50_ms, round(coalesce(p95, 0e0), 6) AS p95_ms, round(coalesce(p99, 0e0), 6) AS p99_ms,
round(coalesce(m, 0e0), 6) AS mean_ms, CASE WHEN s > 0 THEN s END AS wall_s, round(CASE WHEN s > 0 THEN coalesce(n, 0) / s END, 6) AS throughput_per_s FROM w LEFT JOIN r ON w.run_id = r.run_id"""))
def speed(spark, sf):
    return O.speed_by_arm(corpus.view(spark, sf, "predictions"), runs(spark, sf))


@query("p13_paid_guard", with_views("prices predictions priced", "SELECT provider, trace_id, arrival FROM priced WHERE (cost_usd <> 0 OR input_tokens <> 0 OR output_tokens <> 0 OR provider NOT IN ('rules', 'linear', 'boosted'))"))
def paid(spark, sf):
    from ..operators.curve import paid_rows

    return paid_rows(priced(spark, sf), FREE).select("provider", "trace_id", "arrival")


@query("p5_public_rows", with_views("prices predictions priced truth thresholds", """SELECT p.trace_id, p.repeat_no, p.provider, p.model_id, round(p.primary_score, 6) AS score,
CASE WHEN p.error IS NOT NULL THEN 'error' WHEN p.primary_score >= h.threshold THEN 'flag' ELSE 'pass' END AS decision, p.predicted_label, round(p.primary_score, 6) AS needs_review,
round(p.latency_ms, 6) AS latency_ms, coalesce(p.input_tokens, 0) AS input_tokens, round(p.cost_usd, 6) AS cost_usd, p.error, t.label, t.fault_type, t.domain
FROM priced p JOIN thresholds h ON p.provider = h.provider LEFT JOIN (SELECT * FROM truth WHERE split <> 'dev') t ON p.trace_id = t.trace_id"""))
def public(spark, sf):
    rows = priced(spark, sf).withColumn("needs_review", F.col("primary_score"))
    return J.public_rows(rows, truth(spark, sf).where("split <> 'dev'"), threshold())


def stored_manifests(spark, sf):
    """Recorded rollups with known faults: every 11th run is off by one row, every 6th by money."""
    number = F.split("run_id", "_")[1].cast("bigint")
    return O.run_manifest(priced(spark, sf)).select(
        "run_id",
        (F.col("n_predictions") + F.when(number % 11 == 0, 1).otherwise(0)).alias("n_predictions"),
        F.when(number % 13 == 0, F.col("total_input_tokens") - 5).otherwise(F.col("total_input_tokens")).alias("total_input_tokens"),
        F.when(number % 6 == 0, F.col("total_cost_usd") + 1e-3).when(number % 6 == 1, None).otherwise(F.col("total_cost_usd")).alias("total_cost_usd"))


@query("v2_v3_verify_runs", with_views("prices predictions priced", """, r AS (SELECT run_id, CAST(substr(run_id, 5) AS BIGINT) AS k, count(cost_usd) = count(*) AS all_priced FROM priced GROUP BY run_id)
SELECT run_id, 'n_predictions' AS problem FROM r WHERE k % 11 = 0 UNION ALL SELECT run_id, 'total_input_tokens' FROM r WHERE k % 13 = 0 UNION ALL
SELECT run_id, 'total_cost' FROM r WHERE k % 6 = 0 AND all_priced UNION ALL SELECT run_id, 'total_cost_missing' FROM r WHERE k % 6 = 1 AND all_priced"""))
def verify_runs(spark, sf):
    return V.rollup_problems(stored_manifests(spark, sf), O.run_manifest(priced(spark, sf)))


_NUMBER = "CAST(substr(run_id, 5) AS BIGINT)"


@query("v2_v3_digest_problems", with_views("predictions runs", f""", r AS (SELECT DISTINCT run_id, {_NUMBER} AS k FROM predictions), a AS (SELECT run_id, count(*) FILTER (WHERE n_attempts > 1) AS again, count(*) FILTER (WHERE error IS NOT NULL) AS cut FROM predictions GROUP BY run_id)
SELECT run_id, 'predictions_mismatch' AS problem FROM r WHERE k % 7 = 0 UNION ALL
SELECT run_id, 'attempts_mismatch' FROM r JOIN a USING (run_id) WHERE k % 9 = 0 AND again > 1 UNION ALL SELECT run_id, 'attempts_missing' FROM r JOIN a USING (run_id) WHERE k % 9 = 0 AND again = 1 UNION ALL
SELECT run_id, 'truncations_missing' FROM r JOIN a USING (run_id) WHERE k % 5 = 1 AND cut > 0 UNION ALL SELECT run_id, 'truncations_count' FROM r JOIN a USING (run_id) WHERE k % 5 = 2 AND cut > 0 UNION ALL
SELECT run_id, 'dataset_mismatch' FROM runs WHERE dataset_id = 'old' AND {_NUMBER} % 2 = 1"""))
def digest_checks(spark, sf):
    """Recorded digests against tables of which some runs were tampered with: a changed score, a lost attempt, a lost account, a replaced data set."""
    k = F.split("run_id", "_")[1].cast("bigint")
    rows = corpus.view(spark, sf, "predictions").select("run_id", "trace_id", "arrival", "primary_score", "error", "n_attempts")
    again, cut = rows.where("n_attempts > 1"), rows.where("error is not null").select("run_id", "trace_id", "error")
    first = rows.groupBy("run_id").agg(F.min_by(F.struct("arrival", "trace_id"), F.struct("arrival", "trace_id")).alias("first"))
    lost = again.groupBy("run_id").agg(F.min_by(F.struct("arrival", "trace_id"), F.struct("arrival", "trace_id")).alias("first"))
    is_first = (F.col("arrival") == F.col("first.arrival")) & (F.col("trace_id") == F.col("first.trace_id"))
    changed = rows.join(first, "run_id").withColumn("primary_score", F.when((k % 7 == 0) & is_first, F.lit(2.0)).otherwise(F.col("primary_score"))).drop("first")
    kept = again.join(lost, "run_id").where(~((k % 9 == 0) & is_first)).drop("first")
    runs = corpus.view(spark, sf, "runs").select("run_id", "dataset_id")
    sets_ = truth(spark, sf).select("trace_id", "label", "template_family").withColumn("dataset_id", F.explode(F.array(F.lit("old"), F.lit("ds1"))))
    replaced = sets_.withColumn("label", F.when((F.col("dataset_id") == "old") & (F.col("trace_id") == "order/1"), "other").otherwise(F.col("label")))

    def recorded(predictions, attempts, truncations, data):
        own = V.digests({"predictions": predictions, "attempts": attempts, "truncations": truncations})
        return own.unionByName(V.shared_digests(runs, V.digests({"dataset": data}, "dataset_id"), "dataset_id"))

    stored = recorded(rows, again, cut, sets_).withColumn("archived", k % 2 == 0)
    stored = stored.withColumn("n_rows", F.when((k % 5 == 2) & (F.col("part") == "truncations"), F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    return V.digest_problems(stored, recorded(changed, kept, cut.where(k % 5 != 1), replaced))


@query("v2_cost_problems", with_views("prices predictions priced", """, c AS (SELECT run_id, trace_id, arrival, cost_usd AS want, CASE WHEN arrival % 97 = 0 THEN coalesce(cost_usd, 0e0) + 1e0 WHEN arrival % 89 = 0 THEN NULL ELSE cost_usd END AS got FROM priced)
SELECT run_id, trace_id, CASE WHEN want IS NULL THEN 'invented_cost' ELSE 'cost_mismatch' END AS problem FROM c
WHERE (want IS NULL AND got IS NOT NULL) OR (want IS NOT NULL AND (got IS NULL OR abs(got - want) > 1e-12))"""))
def cost_problems(spark, sf):
    rows = priced(spark, sf).withColumnRenamed("cost_usd", "expected_usd")
    tampered = rows.withColumn("cost_usd", F.when(F.col("arrival") % 97 == 0, F.coalesce("expected_usd", F.lit(0.0)) + 1.0)
                               .when(F.col("arrival") % 89 == 0, None).otherwise(F.col("expected_usd")))
    return V.cost_problems(tampered)


@query("v6_price_chain", """WITH c AS (SELECT concat('model_', CAST(p_partkey // 4 AS STRING)) AS model_id, p_brand AS manifest_date, p_partkey % 4 AS revision, p_size / 1e1 AS in_rate, p_retailprice / 1e3 AS out_rate FROM part),
l AS (SELECT *, lag(in_rate) OVER w AS old_in_rate, lag(out_rate) OVER w AS old_out_rate, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY model_id ORDER BY manifest_date, revision))
SELECT model_id, manifest_date, revision, round(old_in_rate, 6) AS old_in_rate, round(in_rate, 6) AS in_rate, round(old_out_rate, 6) AS old_out_rate, round(out_rate, 6) AS out_rate
FROM l WHERE k > 1 AND (in_rate IS DISTINCT FROM old_in_rate OR out_rate IS DISTINCT FROM old_out_rate)""")
def price_chain(spark, sf):
    part = corpus.base(spark, sf, "part").select(
        F.concat(F.lit("model_"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("model_id"), F.col("p_brand").alias("manifest_date"), (F.col("p_partkey") % 4).alias("revision"),
        (F.col("p_size") / 10.0).alias("in_rate"), (F.col("p_retailprice") / 1000.0).alias("out_rate"))
    return V.price_chain(part)
