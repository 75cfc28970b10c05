"""Queries over intervals, gates, verdicts, curves and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..session import settle
from ..operators import calibration as C, curve as K, gates as G, intervals as I, joins as J, operational as O, ranking as R, runs as N, sampling as M
from . import corpus
from .corpus import RANKED, SCORED, with_views
from .lanes import FX, GENERAL, LANE, PAIR, RULES, STRONG, truth
from .registry import query
from .scoring import AP, ARM, ROC, priced, ranked, recall_sql, scored, threshold

B, SEED = 10_000, 7
HASH = "CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT)"


def _boot_sql(arms: str, key: str = "") -> str:
    """Check-side bootstrap over a table ``base`` (key, ord, y, arm score columns)."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    on = f"n.{key} = d.{key} AND " if key else ""
    dk = f"d.{key}, " if key else ""
    nk = f"n.{key}, " if key else ""
    sides = " UNION ALL ".join(f"SELECT {k}r, '{a}' AS arm, {a} AS score, y FROM drawn" for a in arms.split())
    return f""", n AS (SELECT *, row_number() OVER ({part}ORDER BY ord) - 1 AS idx, count(*) OVER ({part.strip()}) AS total FROM base),
d AS (SELECT {nk}r, {HASH.format(f"concat('{SEED}:', CAST(r AS STRING), ':', CAST(idx AS STRING))")} % total AS pick FROM n, range({B}) AS v(r)),
drawn AS (SELECT {dk}d.r, n.* EXCLUDE ({key + ', ' if key else ''}idx, total) FROM d JOIN n ON {on}n.idx = d.pick),
sides AS ({sides}), g AS (SELECT {k}arm, r, score, count(*) AS n, sum(y) AS pos FROM sides GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER w - n AS before_n, sum(pos) OVER w - pos AS before_pos, sum(n) OVER (PARTITION BY {k}arm, r) AS total_n, sum(pos) OVER (PARTITION BY {k}arm, r) AS total_pos
           FROM g WINDOW w AS (PARTITION BY {k}arm, r ORDER BY score DESC)),
vals AS (SELECT {k}arm, r, {AP} AS auprc, {ROC} AS auroc, {recall_sql('5e-2')} AS recall_at_budget FROM ranked GROUP BY {k}arm, r HAVING max(total_pos) > 0 AND max(total_pos) < max(total_n))"""


_BASE = PAIR + ", base AS (SELECT a.ord, a.y, a.score AS score_a, b.score AS score_b FROM a JOIN b ON a.trace_id = b.trace_id)"
_BASE = _BASE.replace("SELECT trace_id, y, score", "SELECT trace_id, ord, y, score")


@query("a28_a30_bootstrap_intervals")
def intervals(spark, sf):
    out = I.bootstrap_interval(scored(spark, sf, ""), ARM, resamples=B, seed=SEED)
    return out.select("provider", "metric", "lower", "upper", "resamples_used")


def pairs(spark, sf):
    return settle(J.paired(J.pair_arms(scored(spark, sf, "ord"), LANE, GENERAL)), "pairs")


_DIFF = """, diff AS (SELECT r, max(auprc) FILTER (WHERE arm = 'score_a') - max(auprc) FILTER (WHERE arm = 'score_b') AS auprc,
max(recall_at_budget) FILTER (WHERE arm = 'score_a') - max(recall_at_budget) FILTER (WHERE arm = 'score_b') AS recall_at_budget FROM vals GROUP BY r)"""


@query("a29_a31_paired_bootstrap", with_views(SCORED, _BASE + _boot_sql("score_a score_b") + _DIFF + " UNION ALL ".join(
    f" SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS lower, round(quantile_cont({m}, 0.975), 6) AS upper, count({m}) AS resamples_used FROM diff" for m in ("auprc", "recall_at_budget"))))
def paired(spark, sf):
    return I.paired_bootstrap(pairs(spark, sf), resamples=B, seed=SEED, portable=True).select("metric", "lower", "upper", "resamples_used")


@query("a28_poisson_intervals")
def poisson(spark, sf):
    return I.bootstrap_interval(scored(spark, sf, ""), ARM, resamples=B, seed=SEED, mode="poisson")


@query("a35_verdict", with_views(SCORED, _BASE + _boot_sql("score_a score_b") + _DIFF + """, q AS (SELECT quantile_cont(auprc, 0.025) AS lo, quantile_cont(auprc, 0.975) AS hi FROM diff)
SELECT 'auprc' AS metric, CASE WHEN lo IS NULL THEN 'not_computable' WHEN lo > 0 THEN 'wins' WHEN hi < 0 THEN 'loses' ELSE 'no_difference' END AS verdict FROM q"""))
def verdict(spark, sf):
    out = I.paired_bootstrap(pairs(spark, sf), metrics=("auprc",), resamples=B, seed=SEED, portable=True)
    return G.with_verdict(out).select("metric", "verdict")


@query("a27_wilson_interval", with_views(SCORED, """, c AS (SELECT provider, fault_type, CAST(count(*) FILTER (WHERE score >= threshold) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY ALL),
w AS (SELECT *, k / n AS p, 1e0 + 3.8416e0 / n AS d FROM c)
SELECT provider, fault_type, round(p, 6) AS point, round(greatest(0e0, (p + 3.8416e0 / (2 * n)) / d - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / d), 6) AS lower,
round(least(1e0, (p + 3.8416e0 / (2 * n)) / d + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / d), 6) AS upper FROM w"""))
def wilson(spark, sf):
    counts = scored(spark, sf, "", "fault_type").groupBy("provider", "fault_type").agg(
        F.count(F.when(F.col("score") >= F.col("threshold"), 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.select("provider", "fault_type", S.wilson(F.col("k"), F.col("n")).alias("w")).select("provider", "fault_type", "w.*")


def summary(spark, sf, rows):
    quality = R.confusion(rows, ARM, F.col("threshold")).select("provider", "precision", "recall")
    calibration = C.ece(C.reliability_bins(rows, ARM), ARM)
    work = corpus.view(spark, sf, "predictions").groupBy("provider").agg(*O.operational_columns())
    return quality.join(calibration, "provider").join(work.select("provider", "error_rate", "parse_failure_count"), "provider")


_E = """, kk AS (SELECT provider, y, score, row_number() OVER (PARTITION BY provider ORDER BY score, ord) AS k, count(*) OVER (PARTITION BY provider) AS n FROM scored),
bb AS (SELECT provider, floor(CAST(k * 10 - 1 AS DOUBLE) / n) AS bin, count(*) AS m, abs(avg(CAST(y AS DOUBLE)) - avg(score)) AS gap, max(n) AS n FROM kk GROUP BY ALL),
ece AS (SELECT provider, sum(CAST(m AS DOUBLE) / n * gap) AS ece FROM bb GROUP BY provider),
cm AS (SELECT provider, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, count(*) AS n FROM scored GROUP BY provider),
op AS (SELECT provider, count(error) / CAST(count(*) AS DOUBLE) AS er, count(*) FILTER (WHERE contains(error, 'ParseFailure')) AS pf FROM predictions GROUP BY provider)"""


@query("a34_gates", with_views(SCORED, _E + """, x AS (SELECT cm.provider, cm.n >= 1000 AND cm.provider <> 'rules' AS staged, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0e0) >= 9e-1 AS po,
coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0) >= 8e-1 AS ro, ece <= 1e-1 AS eo, er < 1e-2 AS xo, pf <= 0 AS fo FROM cm JOIN ece ON cm.provider = ece.provider JOIN op ON cm.provider = op.provider),
v AS (SELECT provider, avg(score) - 4e-1 AS lo, avg(score) - 2.5e-1 AS hi FROM scored GROUP BY provider)
SELECT x.provider, staged AS useful_reported, CASE WHEN staged AND x.provider <> 'rules' THEN lo > 5e-2 OR hi * 1e2 >= 1e1 END AS useful_passed,
CASE WHEN x.provider <> 'boosted' THEN lo > 0 END AS beats_strong, CASE WHEN x.provider <> 'boosted' THEN hi < 0 END AS loses_to_strong,
po AS precision_ok, ro AS recall_ok, eo AS ece_ok, xo AS error_rate_ok, fo AS parse_failures_ok, po AND ro AND eo AND xo AND fo AS deployment_passed FROM x JOIN v ON x.provider = v.provider"""))
def gates(spark, sf):
    # Differences stand in for a written comparison table; each grows from the scores.
    rows = scored(spark, sf, "ord")
    versus = rows.groupBy("provider").agg((F.avg("score") - 0.4).alias("lower"), (F.avg("score") - 0.25).alias("upper"))
    base = versus.where("provider <> 'rules'").select("provider", F.col("lower").alias("auprc_lower"), F.col("upper").alias("recall_delta"))
    sizes = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n_records"))
    return G.gates(summary(spark, sf, rows).join(sizes, "provider"), base, versus.where("provider <> 'boosted'"), RULES, F.col("n_records"))


@query("a49_claims", with_views(SCORED + " prices priced", """, v AS (SELECT provider, avg(score) - 5e-1 AS lo, avg(score) - 3.5e-1 AS hi FROM scored GROUP BY provider),
c AS (SELECT provider, avg(CASE WHEN provider <> 'typed' THEN cost_usd END) AS m FROM priced GROUP BY provider)
SELECT provider, concat(provider, CASE WHEN lo > 0 THEN ' beats ' WHEN hi < 0 THEN ' trails ' ELSE ' is not told apart from ' END, 'boosted') AS text,
CASE WHEN lo > 0 THEN 'for' WHEN hi < 0 THEN 'against' ELSE 'neutral' END AS stance FROM v UNION ALL
SELECT provider, concat(provider, ' has no price on record'), 'caveat' FROM c WHERE m IS NULL"""))
def claims(spark, sf):
    versus = scored(spark, sf, "").groupBy("provider").agg((F.avg("score") - 0.5).alias("lower"), (F.avg("score") - 0.35).alias("upper"))
    prices = O.cost_per_1000(priced(spark, sf).withColumn("cost_usd", F.when(F.col("provider") != LANE, F.col("cost_usd"))), ARM, FX)
    return G.claims(G.with_verdict(versus).withColumn("rival", F.lit(STRONG)), prices)


@query("a50_caveats", with_views("predictions", """, f AS (SELECT provider, CASE WHEN provider = 'rules' THEN 'synthetic' ELSE 'real' END AS kind, avg(primary_score) - 5e-1 AS lo, avg(primary_score) - 3.5e-1 AS hi,
count(error) AS tr, count(*) AS n, count(*) FILTER (WHERE n_attempts > 1) AS dv FROM predictions GROUP BY provider)
SELECT provider, 'synthetic_data' AS caveat, 'warning' AS severity FROM f WHERE kind = 'synthetic' UNION ALL SELECT provider, 'real_labels_from_ground_truth', 'info' FROM f WHERE kind = 'real' UNION ALL
SELECT provider, 'interval_crosses_zero', 'warning' FROM f WHERE lo <= 0 AND hi >= 0 UNION ALL SELECT provider, 'interval_wide', 'info' FROM f WHERE hi - lo > 1e-1 UNION ALL
SELECT provider, 'traces_shortened', 'warning' FROM f WHERE tr > 0 UNION ALL SELECT provider, 'request_parameters_dropped', 'info' FROM f WHERE dv > 0"""))
def caveats(spark, sf):
    facts = corpus.view(spark, sf, "predictions").groupBy("provider").agg(
        F.when(F.col("provider") == "rules", "synthetic").otherwise("real").alias("kind"), (F.avg("primary_score") - 0.5).alias("lower"),
        (F.avg("primary_score") - 0.35).alias("upper"), F.count("error").alias("truncated"), F.count(F.lit(1)).alias("n_traces"),
        F.count(F.when(F.col("n_attempts") > 1, 1)).alias("deviations"))
    return G.caveats(facts)


_NEWEST = """, newest AS (SELECT provider, run_id FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY created_utc DESC, run_id DESC) AS k FROM runs WHERE status = 'complete' AND split = 'test') q WHERE k = 1),
mine AS (SELECT p.* FROM predictions p JOIN newest ON p.run_id = newest.run_id), """ + ", ".join(f"{n} AS ({corpus.SHARED[n].replace('FROM predictions', 'FROM mine')})" for n in ("zero_repeat", "points", "scored", "groups", "ranked"))


@query("a51_reference_metrics", with_views("truth predictions thresholds runs", _NEWEST + f""",
e AS (SELECT provider, score, y, row_number() OVER (PARTITION BY provider ORDER BY score, ord) AS k, count(*) OVER (PARTITION BY provider) AS n FROM scored),
b AS (SELECT provider, floor(CAST(k * 10 - 1 AS DOUBLE) / n) AS bin, count(*) AS m, abs(avg(CAST(y AS DOUBLE)) - avg(score)) AS gap, max(n) AS n FROM e GROUP BY ALL),
ec AS (SELECT provider, sum(CAST(m AS DOUBLE) / n * gap) AS ece FROM b GROUP BY provider),
m AS (SELECT provider, {AP} AS auprc, {ROC} AS auroc FROM ranked GROUP BY provider), v AS (SELECT DISTINCT provider FROM runs)
SELECT v.provider, w.run_id, round(auprc, 6) AS auprc, round(auroc, 6) AS auroc, round(ece, 6) AS ece, CASE WHEN w.run_id IS NULL THEN 'no complete run' WHEN m.provider IS NULL THEN 'nothing scored' WHEN auprc IS NULL THEN 'one class only' ELSE 'scored' END AS reason
FROM v LEFT JOIN newest w ON v.provider = w.provider LEFT JOIN m ON v.provider = m.provider LEFT JOIN ec ON v.provider = ec.provider"""))
def reference(spark, sf):
    """The newest complete run of each provider on the split; a provider without numbers stays, with the reason."""
    runs = corpus.view(spark, sf, "runs").select("provider", "run_id", "created_utc", "status", "split")
    newest = N.latest_run(runs.where("status = 'complete' AND split = 'test'")).select("provider", "run_id")
    mine = corpus.view(spark, sf, "predictions").join(newest.select("run_id"), "run_id", "left_semi")
    rows = J.score_join(J.point_predictions(mine), truth(spark, sf).drop("ord")).withColumn("threshold", threshold())
    rank = R.ranked_groups(R.score_groups(rows, ARM), ARM).groupBy("provider").agg(R.auprc_of().alias("auprc"), R.auroc_of().alias("auroc"))
    known = runs.select("provider").distinct().join(newest, "provider", "left").join(rank.withColumn("_seen", F.lit(True)), "provider", "left")
    reason = F.when(F.col("run_id").isNull(), "no complete run").when(F.col("_seen").isNull(), "nothing scored").when(F.col("auprc").isNull(), "one class only").otherwise("scored")
    return known.join(C.ece(C.reliability_bins(rows, ARM), ARM), "provider", "left").select("provider", "run_id", "auprc", "auroc", "ece", reason.alias("reason"))


# -- curves ---------------------------------------------------------------------------

_T = "CASE WHEN n - 1 <= 0 THEN NULL WHEN n - 1 = 1 THEN 1.2706e1 WHEN n - 1 = 2 THEN 4.303e0 WHEN n - 1 = 3 THEN 3.182e0 WHEN n - 1 = 4 THEN 2.776e0 END"
_CURVE = f""", s AS (SELECT provider, n_train, max(n_calibration) AS n_calibration, avg(auprc) AS mean, stddev_samp(auprc) AS sd, min(auprc) AS lo, max(auprc) AS hi, count(*) AS n FROM curve_points GROUP BY ALL),
cs AS (SELECT *, coalesce({_T} * sd / sqrt(CAST(n AS DOUBLE)), 0e0) AS half FROM s)"""


@query("a38_curve_summary", with_views("curve_points", _CURVE + """ SELECT provider, n_train, n_calibration, round(mean, 6) AS mean, round(coalesce(sd, 0e0), 6) AS sd, round(mean - half, 6) AS lower, round(mean + half, 6) AS upper,
round(lo, 6) AS "min", round(hi, 6) AS "max", n FROM cs"""))
def curve_summary(spark, sf):
    return K.curve_summary(corpus.view(spark, sf, "curve_points"))


@query("w13_size_spread", with_views("curve_points", _CURVE + " SELECT provider, n_train, round(mean, 6) AS mean, round(mean - lag(mean) OVER (PARTITION BY provider ORDER BY n_train), 6) AS gain FROM cs"))
def spread(spark, sf):
    return K.size_spread(K.curve_summary(corpus.view(spark, sf, "curve_points")))


def references(spark, sf):
    return ranked(spark, sf).where(F.col("provider").isin(LANE, GENERAL)).groupBy(F.col("provider").alias("reference")).agg(R.auprc_of().alias("reference_auprc"))


_REF = f", ref AS (SELECT provider AS reference, {AP} AS reference_auprc FROM ranked WHERE provider IN ('typed', 'general') GROUP BY provider)"
_CROSS = _CURVE + _REF + """, j AS (SELECT cs.*, mean - half AS lower, ref.* FROM cs, ref),
h AS (SELECT *, bool_and(coalesce(mean > reference_auprc, false)) OVER w AS mh, bool_and(coalesce(lower > reference_auprc, false)) OVER w AS lh FROM j
      WINDOW w AS (PARTITION BY provider, reference ORDER BY n_train ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT provider, reference, reference_auprc, min(n_train) FILTER (WHERE mh) AS mean_n, min(n_train) FILTER (WHERE lh) AS lower_n, min(mean) FILTER (WHERE mh) AS mv, min(n_train) AS small, max(n_train) AS large,
      min_by(mean > reference_auprc, n_train) AS first_beats, bool_or(mean < reference_auprc) AS leads FROM h GROUP BY ALL)"""
CURVE_REF = RANKED + " curve_points"


@query("w6_m13_crossover", with_views(CURVE_REF, _CROSS + """ SELECT provider, reference, round(reference_auprc, 6) AS reference_auprc, mean_n, lower_n, small AS smallest_n, large AS largest_n, first_beats AS beats_at_smallest, leads AS reference_leads_anywhere,
CASE WHEN mean_n IS NULL THEN concat(provider, ' never beats ', reference, ' up to ', CAST(large AS STRING), ' labels') WHEN first_beats AND mean_n = small THEN concat(provider, ' beats ', reference, ' at the smallest size, ', CAST(small AS STRING), ' labels')
ELSE concat(provider, ' needs about ', CAST(mean_n AS STRING), ' labels to beat ', reference) END AS statement FROM x"""))
def crossover(spark, sf):
    return K.curve_rebuild(corpus.view(spark, sf, "curve_points"), references(spark, sf)).drop("mean_value", "margin")


@query("j14_curve_vs_reference", with_views(CURVE_REF, _CURVE + _REF + " SELECT cs.provider, n_train, round(mean, 6) AS mean, reference, round(reference_auprc, 6) AS reference_auprc FROM cs, ref"))
def curve_reference(spark, sf):
    return J.curve_vs_reference(K.curve_summary(corpus.view(spark, sf, "curve_points")), references(spark, sf)).select("provider", "n_train", "mean", "reference", "reference_auprc")


@query("a53_crossover_markers", with_views(CURVE_REF, _CROSS + " SELECT mean_n AS n_train, string_agg(concat(provider, '>', reference), ',' ORDER BY provider, reference) AS lines FROM x WHERE mean_n IS NOT NULL GROUP BY mean_n"))
def markers(spark, sf):
    return K.crossover_markers(K.curve_rebuild(corpus.view(spark, sf, "curve_points"), references(spark, sf)))


@query("s17_newest_curve", with_views("curve_points", """, c AS (SELECT *, concat('curve-', CAST(seed AS STRING)) AS curve_id, CASE WHEN n_train < 100 THEN 'dev' ELSE 'test' END AS split, CASE WHEN seed = 4 THEN 'old' ELSE 'ds1' END AS dataset_id FROM curve_points)
SELECT curve_id, provider, n_train, round(auprc, 6) AS auprc FROM c WHERE split = 'test' AND dataset_id = 'ds1' AND curve_id = (SELECT max(curve_id) FROM c WHERE split = 'test' AND dataset_id = 'ds1')"""))
def newest_curve(spark, sf):
    rows = corpus.view(spark, sf, "curve_points").select("*", F.concat(F.lit("curve-"), F.col("seed").cast("string")).alias("curve_id"),
        F.when(F.col("n_train") < 100, "dev").otherwise("test").alias("split"), F.when(F.col("seed") == 4, "old").otherwise("ds1").alias("dataset_id"))
    return K.newest_curve(rows, "test", "ds1").select("curve_id", "provider", "n_train", "auprc")


@query("f33_t_critical", with_views("truth", ", d AS (SELECT count(*) % 40 AS df, template_family FROM truth GROUP BY template_family) SELECT template_family, df, " +
    "CASE WHEN df <= 0 THEN NULL WHEN df > 30 THEN 1.96e0 " + " ".join(f"WHEN df >= {d} THEN CAST({v} AS DOUBLE)" for d, v in reversed(S.T_975)) + " END AS t FROM d"))
def t_critical(spark, sf):
    d = truth(spark, sf).groupBy("template_family").agg((F.count(F.lit(1)) % 40).alias("df"))
    return d.withColumn("t", S.t_critical(F.col("df")))


@query("f34_size_label", with_views("curve_points", "SELECT provider, seed, n_train, CASE WHEN n_train = 800 THEN 'full' ELSE CAST(n_train AS STRING) END AS label, CASE WHEN n_train <> 800 THEN n_train END AS parsed FROM curve_points"))
def size_label(spark, sf):
    rows = corpus.view(spark, sf, "curve_points").withColumn("label", S.size_label(F.when(F.col("n_train") != 800, F.col("n_train"))))
    return rows.select("provider", "seed", "n_train", "label", S.parse_size(F.col("label")).alias("parsed"))


@query("o8_numeric_label_sort", with_views(SCORED, ", b AS (SELECT provider, concat(CAST(v.p AS STRING), '%') AS budget, v.p FROM (SELECT DISTINCT provider FROM scored) s, (VALUES (1), (5), (10), (20)) AS v(p)) SELECT provider, budget, row_number() OVER (PARTITION BY provider ORDER BY p) AS place FROM b"))
def numeric_sort(spark, sf):
    from pyspark.sql import Window

    rows = R.recall_at_budgets(ranked(spark, sf), ARM)
    label = F.concat(F.round(F.col("budget") * 100).cast("int").cast("string"), F.lit("%"))
    return rows.select("provider", label.alias("budget"), F.row_number().over(Window.partitionBy("provider").orderBy("budget")).alias("place"))


# -- samples ---------------------------------------------------------------------------


@query("f35_f36_make_splits", with_views("truth", """, u AS (SELECT DISTINCT template_family FROM truth), r AS (SELECT template_family, row_number() OVER (ORDER BY md5(concat('20260919:splits:', template_family)), template_family) - 1 AS k, count(*) OVER () AS n FROM u)
SELECT template_family, CASE WHEN k < greatest(1, round_even(n * 6e-1, 0)) THEN 'dev' WHEN k < greatest(1, round_even(n * 6e-1, 0)) + greatest(1, round_even(n * 2e-1, 0)) THEN 'validation' ELSE 'test' END AS split FROM r"""))
def make_splits(spark, sf):
    return M.make_splits(truth(spark, sf), 20260919)


@query("s13_load_splits", with_views("split_unit", "SELECT template_family, split FROM split_unit"))
def load_splits(spark, sf):
    from ..sources.dims import split_rows

    # Each unit travels as the JSON text of a split document that holds it.
    units = corpus.view(spark, sf, "split_unit")
    doc = F.concat(F.lit('{"seed":1,"'), F.col("split"), F.lit('":["'), F.col("template_family"), F.lit('"]}'))
    return split_rows(units.select(doc.alias("value")))


@query("w10_audit_sample", with_views("truth", "SELECT trace_id, concat(label, '/', fault_type) AS audit_stratum FROM (SELECT *, row_number() OVER (PARTITION BY label, fault_type ORDER BY trace_id) AS k FROM truth) q WHERE k <= 8"))
def audit_sample(spark, sf):
    return M.audit_sample(truth(spark, sf))


@query("w11_systematic_sample", with_views("truth", ", r AS (SELECT trace_id, ord, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS n FROM truth WHERE label = 'unsupported_success') SELECT trace_id, ord FROM r WHERE i IN (SELECT (v.k * (SELECT max(n) FROM r)) // 97 FROM range(97) AS v(k))"))
def systematic(spark, sf):
    return M.systematic_sample(truth(spark, sf).where("label = 'unsupported_success'").select("trace_id", "ord"), "ord", 97)


_LABELS = "supported_success unsupported_success reported_failure_or_uncertainty no_success_claim".split()
_ADMIT = f""", pool AS (SELECT * FROM truth WHERE split = 'dev'), tot AS (SELECT count(*) AS n, {', '.join(f"count(*) FILTER (WHERE label = '{l}') AS c{i}" for i, l in enumerate(_LABELS))} FROM pool),
e AS (SELECT v.label, v.i, 60e0 * CASE v.i WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END / n AS x, CASE v.i WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS c FROM tot, (VALUES {', '.join(f"('{l}', {i})" for i, l in enumerate(_LABELS))}) AS v(label, i)),
q AS (SELECT label, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, c DESC, label DESC) <= 60 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS need FROM e),
u AS (SELECT template_family, md5(concat('3:', template_family)) AS k, {', '.join(f"count(*) FILTER (WHERE label = '{l}') AS c{i}" for i, l in enumerate(_LABELS))} FROM pool GROUP BY template_family),
a AS (SELECT *, {', '.join(f"sum(c{i}) OVER w - c{i} AS b{i}" for i in range(4))} FROM u WINDOW w AS (ORDER BY k, template_family)),
adm AS (SELECT * FROM a WHERE {' OR '.join(f"b{i} < (SELECT need FROM q WHERE label = '{l}')" for i, l in enumerate(_LABELS))})"""


@query("w7_task_admission", with_views("truth", _ADMIT + " SELECT template_family, k AS order_key FROM adm"))
def admission(spark, sf):
    pool = truth(spark, sf).where("split = 'dev'")
    return M.task_admission(pool, M.label_quota(pool, 60), 3).select("template_family", "order_key")


@query("w8_w9_m11_label_budget_subsample", with_views("truth", _ADMIT + """, r AS (SELECT p.trace_id, p.label, p.template_family, row_number() OVER (PARTITION BY p.label ORDER BY adm.k, p.template_family, p.ord) AS place FROM pool p JOIN adm ON p.template_family = adm.template_family)
SELECT trace_id, r.label, template_family FROM r JOIN q ON r.label = q.label WHERE place <= need"""))
def budget_sample(spark, sf):
    return M.subsample(truth(spark, sf).where("split = 'dev'"), 60, 3).select("trace_id", "label", "template_family")
