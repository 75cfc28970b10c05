"""Queries over audits, figures, data-set listings and whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S, text as X
from ..session import settle, work_folder
from ..operators import audit as A, intervals as I, leakage as K, ranking as R, report as P, rules as U, sampling as M
from ..sources import dims, release, traces as TR
from . import corpus
from .corpus import PROVIDERS, RANKED, SCORED, with_views
from .decisions import B, SEED, _BASE, _DIFF, _boot_sql
from .lanes import CONTROL, FAULT, FX, GENERAL, LANE, truth
from .registry import query
from .scoring import AP, ARM, priced, ranked, recall_sql, scored, threshold

_SHEET = """, key AS (SELECT trace_id, label, fault_type, template_family, concat(label, '/', fault_type) AS audit_stratum, CASE WHEN row_number() OVER (PARTITION BY label, fault_type ORDER BY trace_id) <= 8 THEN 'TRUE' ELSE 'FALSE' END AS in_sample FROM truth),
sheet AS (SELECT CASE WHEN ord % 101 = 0 THEN concat(trace_id, '/x') ELSE trace_id END AS trace_id, CASE WHEN ord % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS in_sample,
CASE WHEN ord % 3 = 0 THEN '' WHEN ord % 5 = 0 THEN 'no_success_claim' ELSE label END AS auditor_label, CASE WHEN ord % 7 = 0 THEN '' ELSE concat('a', CAST(ord % 2 AS STRING)) END AS auditor_id FROM truth)"""


def sheet(spark, sf):
    o = F.col("ord")
    return TR.clean_sheet(truth(spark, sf).select(
        F.when(o % 101 == 0, F.concat("trace_id", F.lit("/x"))).otherwise(F.col("trace_id")).alias("trace_id"), F.when(o % 2 == 0, " true").otherwise("false").alias("in_sample"),
        F.when(o % 3 == 0, "  ").when(o % 5 == 0, "no_success_claim ").otherwise(F.col("label")).alias("auditor_label"), F.when(o % 7 == 0, "").otherwise(F.concat(F.lit(" a"), (o % 2).cast("string"))).alias("auditor_id"),
        F.lit("").alias("auditor_fault_type"), F.lit("").alias("auditor_note")))


def key(spark, sf):
    t = truth(spark, sf)
    return TR.audit_key(t, M.audit_sample(t))


@query("a36_j6_s16_audit_agreement", with_views("truth", _SHEET + """, j AS (SELECT s.*, k.label, k.in_sample AS ks FROM sheet s LEFT JOIN key k ON s.trace_id = k.trace_id WHERE auditor_label <> '')
SELECT count(*) AS n_audited, count(*) FILTER (WHERE label = auditor_label) AS n_agree, count(*) FILTER (WHERE label IS NULL) AS n_without_key, count(*) FILTER (WHERE label <> auditor_label) AS n_corrections,
count(DISTINCT CASE WHEN auditor_id <> '' THEN auditor_id END) AS n_auditors, (SELECT count(*) FROM key) AS n_records, (SELECT count(*) FROM key WHERE in_sample = 'TRUE') AS n_sample, count(*) FILTER (WHERE ks = 'TRUE') AS n_sample_audited,
round(count(*) / CAST((SELECT count(*) FROM key) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (WHERE ks = 'TRUE') / CAST((SELECT count(*) FROM key WHERE in_sample = 'TRUE') AS DOUBLE), 6) AS sample_coverage,
round(count(*) FILTER (WHERE label = auditor_label) / CAST(count(*) AS DOUBLE), 6) AS agreement FROM j"""))
def agreement(spark, sf):
    return A.audit_agreement(sheet(spark, sf), key(spark, sf))


@query("a36_audit_strata", with_views("truth", _SHEET + " SELECT k.audit_stratum, count(*) AS sampled, count(s.trace_id) AS audited FROM key k LEFT JOIN (SELECT DISTINCT trace_id FROM sheet WHERE auditor_label <> '') s ON k.trace_id = s.trace_id WHERE k.in_sample = 'TRUE' GROUP BY k.audit_stratum"))
def strata(spark, sf):
    return A.audit_strata(sheet(spark, sf), key(spark, sf))


@query("a37_audit_status", with_views("truth", _SHEET + ", c AS (SELECT count(*) FILTER (WHERE auditor_label <> '') AS filled, count(*) FILTER (WHERE in_sample = 'TRUE') AS in_sample FROM sheet) SELECT CASE WHEN filled = 0 THEN 'not_performed' WHEN filled < in_sample THEN 'partial' ELSE 'performed' END AS status, filled, in_sample FROM c"))
def audit_status(spark, sf):
    return A.audit_status(sheet(spark, sf))


@query("s15_audit_key", with_views("truth", "SELECT trace_id, domain, template_family, label, fault_type, concat(label, '/', fault_type) AS audit_stratum, CASE WHEN row_number() OVER (PARTITION BY label, fault_type ORDER BY trace_id) <= 8 THEN 'TRUE' ELSE 'FALSE' END AS in_sample FROM truth"))
def audit_key(spark, sf):
    return key(spark, sf)


def doc_traces(spark, sf):
    from .traces import doc_traces as base

    return base(spark, sf).withColumns({"domain": F.lit("d"), "template_family": F.col("source"), "label": F.lit("no_success_claim"), "fault_type": F.col("source"), "oracle": F.lit('{"n":1}')})


@query("s15_f23_blind_sheet")
def blind(spark, sf):
    t = doc_traces(spark, sf)
    return TR.blind_sheet(t, M.audit_sample(t))


@query("s2_canonical_trace_lines")
def trace_lines(spark, sf):
    return TR.canonical_trace_line(doc_traces(spark, sf))


def round_trip(df, name: str, write, read):
    """Write into a fresh shared folder, then read back from it."""
    folder = work_folder(df.sparkSession, name)
    write(df, folder)
    return read(df.sparkSession, folder)


@query("s1_s2_trace_round_trip", "SELECT concat('doc/', CAST(doc_id AS STRING)) AS trace_id, source AS template_family, len(string_split(text, chr(10))) AS events FROM documents")
def read_traces(spark, sf):
    rows = round_trip(doc_traces(spark, sf), "traces", TR.export_traces, TR.read_traces)
    return rows.select("trace_id", "template_family", F.size("events").cast("bigint").alias("events"))


@query("s10_write_run", with_views("prices predictions priced", "SELECT run_id, count(*) AS n, count(cost_usd) AS n_priced, round(sum(cost_usd), 6) AS cost_usd, CAST(sum(n_attempts) AS BIGINT) AS attempts FROM priced GROUP BY run_id"))
def write_run(spark, sf):
    attempt = lambda i: F.struct((i + 1).cast("int").alias("attempt_number"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error_class"), F.lit(0.0).alias("retry_delay_seconds"), F.lit(1.0).alias("latency_ms"))
    p = corpus.view(spark, sf, "predictions").withColumn("attempts", F.transform(F.sequence(F.lit(0), F.col("n_attempts") - 1), attempt))
    secrets = X.secret_table(spark, ["hunter2-hunter2"])

    def read(s, folder):
        rows = s.read.parquet(f"{folder}/run/predictions").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("cost_usd").alias("n_priced"), F.sum("cost_usd").alias("cost_usd"))
        return rows.join(s.read.parquet(f"{folder}/run/attempts").groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts")), "run_id")

    return round_trip(p, "run", lambda df, f: TR.write_run(df, corpus.view(spark, sf, "prices"), secrets, f"{f}/run"), read)


@query("s18_load_questions", "SELECT conv_id, max(length(concat('{\"instructions\":\"', role, '\",\"type\":\"t\"}'))) AS longest_question_chars FROM conversations GROUP BY conv_id")
def questions(spark, sf):
    doc = F.concat(F.lit('{"q'), F.col("turn").cast("string"), F.lit('":{"type":"t","instructions":"'), F.col("role"), F.lit('"}}'))
    rows = corpus.base(spark, sf, "conversations").select("conv_id", doc.alias("value"))
    parsed = dims.question_rows(rows.select("value")).select("chars", "body")
    keyed = rows.select("conv_id", F.explode(F.from_json("value", "map<string,string>")).alias("q", "raw")).withColumn("body", X.canonical_json(F.col("raw")))
    return keyed.join(parsed.distinct(), "body").groupBy("conv_id").agg(F.max("chars").alias("longest_question_chars"))


@query("s21_list_datasets", "SELECT source AS dataset_id, CASE WHEN min(doc_id) % 2 = 0 THEN 'real' ELSE 'synthetic' END AS kind, count(*) AS records FROM documents GROUP BY source HAVING count(*) > 30")
def datasets(spark, sf):
    rows = corpus.base(spark, sf, "documents").groupBy(F.col("source").alias("dataset_id")).agg(
        F.when(F.min("doc_id") % 2 == 0, "real").otherwise("synthetic").alias("kind"), F.count(F.lit(1)).alias("records"))
    return TR.list_datasets(rows.withColumn("exists", F.col("records") > 30))


@query("a52_provenance_row", with_views("truth", f"""SELECT 'orders' AS dataset_id, 'real' AS kind, (SELECT string_agg(concat(label, '=', CAST(n AS STRING)), ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM truth GROUP BY label) q) AS labels,
(SELECT string_agg(concat(split, '=', CAST(n AS STRING)), ',' ORDER BY split) FROM (SELECT split, count(DISTINCT template_family) AS n FROM truth GROUP BY split) q) AS splits, (SELECT count(*) FROM truth) AS seen"""))
def provenance(spark, sf):
    t = truth(spark, sf)
    units = corpus.view(spark, sf, "split_unit")
    counts = t.agg(F.count(F.lit(1)).alias("seen"))
    row = release.provenance_row(t, counts, units, "orders", "real")
    text = lambda m: F.concat_ws(",", F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return row.select("dataset_id", "kind", text("label_counts").alias("labels"), text("split_sizes").alias("splits"), "seen")


# -- figures --------------------------------------------------------------------------------


def headline_rows(spark, sf):
    rows = scored(spark, sf, "")
    metrics = R.ranking_metrics(R.ranked_groups(R.score_groups(rows, ARM), ARM), ARM)
    spread = I.bootstrap_interval(rows, ARM, metrics=("auprc",), resamples=B, seed=SEED)
    return P.figure_table("auprc", P.figure_points(metrics, spread, "auprc", PROVIDERS), "provider", "ord", extras=("n",))


@query("j16_f39_headline_figure")
def headline(spark, sf):
    return headline_rows(spark, sf)


@query("j16_f39_figure_points", with_views(RANKED, f""", m AS (SELECT provider, {AP} AS y, max(total_n) AS n FROM ranked GROUP BY provider)
SELECT 'auprc' AS figure, provider AS series, CAST(list_position(['rules', 'linear', 'boosted', 'typed', 'general'], provider) - 1 AS STRING) AS x, round(y, 6) AS y, true AS covered, printf('%.3f', y) AS shown, CAST(CAST(n AS BIGINT) AS STRING) AS n FROM m"""))
def figure_points(spark, sf):
    """The figure with its interval as a yes or no: whether it holds the point."""
    rows = headline_rows(spark, sf)
    return rows.withColumn("covered", (F.col("lower") <= F.col("y")) & (F.col("y") <= F.col("upper"))).select("figure", "series", "x", "y", "covered", "shown", "n")


@query("f38_format_value", with_views(RANKED, f"SELECT provider, printf('%.3f', {AP}) AS shown FROM ranked GROUP BY provider"))
def formatted(spark, sf):
    rows = ranked(spark, sf).groupBy("provider").agg(R.auprc_of().alias("auprc"))
    return rows.select("provider", S.format_value(F.col("auprc")).alias("shown"))


def tables(spark, sf):
    return P.report_tables(corpus.view(spark, sf, "predictions"), corpus.view(spark, sf, "truth").drop("ord"), corpus.view(spark, sf, "prices"), threshold(), FAULT, CONTROL, FX)


@query("s20_report_primary_metrics", with_views(RANKED, f""", c AS (SELECT provider, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, avg((score - y) * (score - y)) AS brier FROM scored GROUP BY provider),
m AS (SELECT provider, {AP} AS auprc, {recall_sql('5e-2')} AS r5 FROM ranked GROUP BY provider) SELECT m.provider, round(auprc, 6) AS auprc, round(r5, 6) AS recall_at_5, tp, fp, fn, round(brier, 6) AS brier FROM m JOIN c ON m.provider = c.provider"""))
def report(spark, sf):
    return tables(spark, sf)["primary_metrics"].select("provider", "auprc", "recall_at_5", "tp", "fp", "fn", "brier")


@query("s19_export_view", with_views("truth", "SELECT trace_id, label, CAST(NULL AS STRING) AS domain FROM truth WHERE split = 'test' UNION ALL SELECT trace_id, NULL, domain FROM truth WHERE split = 'validation'"))
def export(spark, sf):
    t = truth(spark, sf)
    parts = [t.where("split = 'test'").select("trace_id", "label"), t.where("split = 'validation'").select("trace_id", "domain")]
    return round_trip(parts[0], "export", lambda _, f: TR.export_view(parts, f"{f}/csv"), lambda s, f: s.read.option("header", "true").csv(f"{f}/csv"))


@query("a54_judge_block", with_views(SCORED + " prices priced", _BASE + _boot_sql("score_a score_b") + _DIFF + """, q AS (SELECT quantile_cont(auprc, 0.025) AS lo, quantile_cont(auprc, 0.975) AS hi FROM diff)
SELECT count(*) AS n_paired, count(*) FILTER (WHERE y = 1) AS n_positives, round(count(*) FILTER (WHERE score_a >= 6e-1 AND y = 1) / CAST(count(*) FILTER (WHERE score_a >= 6e-1) AS DOUBLE), 6) AS arm_precision,
round(count(*) FILTER (WHERE score_b >= 5e-1 AND y = 1) / CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE), 6) AS rival_recall, (SELECT round(lo, 6) FROM q) AS lower, (SELECT round(hi, 6) FROM q) AS upper,
(SELECT CASE WHEN lo > 0 THEN 'wins' WHEN hi < 0 THEN 'loses' ELSE 'no_difference' END FROM q) AS verdict, (SELECT round(avg(cost_usd) * 1e3, 6) FROM priced WHERE provider = 'typed') AS arm_cost_per_1000 FROM base"""))
def judge(spark, sf):
    row = P.judge_block(scored(spark, sf, "ord"), priced(spark, sf), LANE, GENERAL, 0.6, 0.5, FX, resamples=B, seed=SEED, portable=True)
    return row.select("n_paired", "n_positives", "arm_precision", "rival_recall", "lower", "upper", "verdict", "arm_cost_per_1000")


@query("v5_clean_subclass_contract")
def clean_subclass(spark, sf):
    from .traces import detected

    events = corpus.view(spark, sf, "trace_events")
    traces = events.groupBy("trace_id").agg(F.min("status").alias("s"), F.count(F.lit(1)).alias("n")).select(
        "trace_id", F.concat(F.lit("d"), (F.col("n") % 3).cast("string")).alias("domain"), F.when(F.col("n") % 2 == 0, "focus").otherwise("control").alias("fault_type"), F.lit("update_record").alias("described_target"))
    return K.clean_subclass_problems(traces, K.evidence_strings(events), detected(spark, sf), "focus", "control")
