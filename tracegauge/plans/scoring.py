"""Queries over scored predictions: ranking, calibration, operations, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scores as S
from ..operators import calibration as C, joins as J, operational as O, ranking as R
from ..schemas import label_dim
from . import corpus
from .corpus import RANKED, SCORED, with_views
from .registry import query

ARM = ["provider"]


def threshold() :
    return J.threshold_of(corpus.THRESHOLDS, corpus.DEFAULT_THRESHOLD)


def points(spark: SparkSession, sf: str, columns: str | None = None) -> DataFrame:
    rows = corpus.view(spark, sf, "predictions")
    return J.point_predictions(rows if columns is None else rows.select("provider", "trace_id", "repeat_no", "arrival", *columns.split()))


def scored(spark: SparkSession, sf: str, columns: str | None = None, facts: str = "") -> DataFrame:
    """Scored rows with every column, or with score, y and the named columns of predictions and of traces.

    The points are folded whole and the scored rows written once, so the plan below cannot drop a column that nobody reads.
    """
    truth = corpus.view(spark, sf, "truth").drop("ord")
    if columns is not None:
        columns, truth = f"primary_score {columns}", truth.select("trace_id", "label", *facts.split())
    return J.score_join(points(spark, sf, columns), truth).withColumn("threshold", threshold())


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked_groups(R.score_groups(scored(spark, sf, ""), ARM), ARM)


AP = "CASE WHEN max(total_pos) > 0 AND max(total_pos) < max(total_n) THEN sum(CAST(pos AS DOUBLE) / total_pos * (before_pos + pos) / (before_n + n)) END"
ROC = """CASE WHEN max(total_pos) > 0 AND max(total_pos) < max(total_n) THEN
  sum(CAST(pos AS DOUBLE) * (total_n - total_pos - (before_n - before_pos) - (n - pos) + 5e-1 * (n - pos)))
  / (CAST(max(total_pos) AS DOUBLE) * (max(total_n) - max(total_pos))) END"""
K = "greatest(1, CAST(ceil({b} * CAST(total_n AS DOUBLE)) AS BIGINT))"


def recall_sql(b: str) -> str:
    k = K.format(b=b)
    return (
        f"CASE WHEN max(total_pos) > 0 THEN CASE WHEN max({k}) >= max(total_n) THEN 1e0 ELSE "
        f"sum(CAST(pos AS DOUBLE) * least(greatest({k} - before_n, 0), n) / n) / max(total_pos) END END"
    )


@query(
    "a4_a5_a9_ranking_metrics",
    with_views(
        RANKED,
        f"""SELECT provider, CAST(max(total_n) AS BIGINT) AS n, CAST(max(total_pos) AS BIGINT) AS positives,
round({AP}, 6) AS auprc, round({ROC}, 6) AS auroc, round({recall_sql('1e-2')}, 6) AS recall_at_1,
round({recall_sql('5e-2')}, 6) AS recall_at_5, round({recall_sql('1e-1')}, 6) AS recall_at_10,
round({recall_sql('2e-1')}, 6) AS recall_at_20 FROM ranked GROUP BY provider""",
    ),
)
def ranking_metrics(spark, sf):
    return R.ranking_metrics(ranked(spark, sf), ARM)


@query("a4_auprc", with_views(RANKED, f"SELECT provider, round({AP}, 6) AS auprc FROM ranked GROUP BY provider"))
def auprc(spark, sf):
    return ranked(spark, sf).groupBy("provider").agg(R.auprc_of().alias("auprc"))


@query(
    "a5_auroc",
    with_views(
        "truth predictions thresholds zero_repeat points scored",
        """, r AS (SELECT provider, y, rank() OVER (PARTITION BY provider ORDER BY score) AS lo,
                count(*) OVER (PARTITION BY provider, score) AS ties FROM scored),
        m AS (SELECT provider, sum(CASE WHEN y = 1 THEN lo + (ties - 1) / 2e0 END) AS rank_sum,
              CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS q FROM r GROUP BY provider)
        SELECT provider, round(CASE WHEN p > 0 AND q > 0 THEN (rank_sum - p * (p + 1) / 2e0) / (p * q) END, 6) AS auroc FROM m""",
    ),
)
def auroc(spark, sf):
    return ranked(spark, sf).groupBy("provider").agg(R.auroc_of().alias("auroc"))


@query(
    "a9_a10_recall_at_budget",
    with_views(
        RANKED,
        " UNION ALL ".join(
            f"""SELECT provider, {b} AS budget, round({recall_sql(b)}, 6) AS recall,
            round(CASE WHEN max(total_pos) > 0 THEN least(1e0, CAST(max({K.format(b=b)}) AS DOUBLE) / max(total_pos)) END, 6) AS ceiling
            FROM ranked GROUP BY provider"""
            for b in ("1e-2", "5e-2", "1e-1", "2e-1")
        ),
    ),
)
def recall_at_budget(spark, sf):
    return R.recall_at_budgets(ranked(spark, sf), ARM)


CONFUSION = """count(*) FILTER (WHERE {f} AND y = 1) AS tp, count(*) FILTER (WHERE {f} AND y = 0) AS fp,
count(*) FILTER (WHERE NOT ({f}) AND y = 1) AS fn, count(*) FILTER (WHERE NOT ({f}) AND y = 0) AS tn"""
RATES = """coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0e0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0) AS recall,
coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0e0) AS fpr"""
F1 = "coalesce(2e0 * precision * recall / nullif(precision + recall, 0), 0e0)"
OUT = f"tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round({F1}, 6) AS f1"


@query(
    "a3_confusion",
    with_views(
        SCORED,
        f""", c AS (SELECT provider, {CONFUSION.format(f='score >= threshold')} FROM scored GROUP BY provider),
        d AS (SELECT *, {RATES} FROM c) SELECT provider, {OUT} FROM d""",
    ),
)
def confusion(spark, sf):
    return R.confusion(scored(spark, sf, ""), ARM, F.col("threshold"))


@query(
    "a3_threshold_grid",
    with_views(
        SCORED,
        f""", g AS (SELECT s.*, t.th FROM scored s, (VALUES (1e-1), (3e-1), (5e-1), (7e-1), (9e-1)) AS t(th)),
        c AS (SELECT provider, th, {CONFUSION.format(f='score >= th')} FROM g GROUP BY provider, th),
        d AS (SELECT *, {RATES} FROM c) SELECT provider, th AS threshold, {OUT} FROM d""",
    ),
)
def threshold_grid(spark, sf):
    return R.confusion_grid(scored(spark, sf, ""), ARM, (0.1, 0.3, 0.5, 0.7, 0.9))


@query("a6_brier", with_views(SCORED, "SELECT provider, round(avg((score - y) * (score - y)), 6) AS brier FROM scored GROUP BY provider"))
def brier(spark, sf):
    return C.brier(scored(spark, sf, ""), ARM)


BINS = """, r AS (SELECT provider, y, score, row_number() OVER (PARTITION BY provider ORDER BY score, ord) AS k,
                  count(*) OVER (PARTITION BY provider) AS n FROM scored),
b AS (SELECT provider, CAST(floor(CAST(k * 10 - 1 AS DOUBLE) / n) AS INT) AS bin, count(*) AS n, avg(score) AS mean_score,
      avg(CAST(y AS DOUBLE)) AS observed_rate, max(n) AS total_n FROM r GROUP BY ALL)"""


@query(
    "a7_ece",
    with_views(SCORED, BINS + " SELECT provider, round(sum(CAST(n AS DOUBLE) / total_n * abs(observed_rate - mean_score)), 6) AS ece FROM b GROUP BY provider"),
)
def ece(spark, sf):
    return C.ece(C.reliability_bins(scored(spark, sf, "ord"), ARM), ARM)


@query(
    "a45_w4_reliability_bins",
    with_views(SCORED, BINS + " SELECT provider, bin, n, round(mean_score, 6) AS mean_score, round(observed_rate, 6) AS observed_rate, total_n FROM b"),
)
def reliability(spark, sf):
    return C.reliability_bins(scored(spark, sf, "ord"), ARM)


@query(
    "a8_macro_f1",
    with_views(
        SCORED,
        """, l AS (SELECT * FROM (VALUES ('supported_success'), ('unsupported_success'), ('reported_failure_or_uncertainty'), ('no_success_claim')) AS v(name)),
        c AS (SELECT provider, name, count(*) FILTER (WHERE label = name AND predicted_label = name) AS tp,
                count(*) FILTER (WHERE label <> name AND predicted_label = name) AS fp,
                count(*) FILTER (WHERE label = name AND coalesce(predicted_label, '') <> name) AS fn
              FROM scored, l GROUP BY provider, name)
        SELECT provider, round(avg(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0)), 6) AS macro_f1 FROM c GROUP BY provider""",
    ),
)
def macro_f1(spark, sf):
    return C.macro_f1(scored(spark, sf, "predicted_label"), ARM)


@query(
    "a11_selective_accuracy",
    with_views(
        SCORED,
        """, r AS (SELECT provider, CASE WHEN label = predicted_label THEN 1 ELSE 0 END AS ok,
                  row_number() OVER (PARTITION BY provider ORDER BY confidence, ord) AS k, count(*) OVER (PARTITION BY provider) AS n
               FROM scored WHERE confidence IS NOT NULL)
        SELECT provider, f AS escalated_fraction, count(*) AS kept, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy
        FROM r, (VALUES (0e0), (5e-2), (1e-1), (2e-1), (4e-1)) AS v(f)
        WHERE k > round_even(f * CAST(n AS DOUBLE), 0) GROUP BY provider, f""",
    ),
)
def selective(spark, sf):
    return C.selective_accuracy(scored(spark, sf, "ord predicted_label confidence"), ARM)


@query(
    "a44_w5_pr_curve",
    with_views(
        RANKED,
        """SELECT provider, round(score, 6) AS score, round(CAST(before_pos + pos AS DOUBLE) / (before_n + n), 6) AS precision,
        round(CAST(before_pos + pos AS DOUBLE) / total_pos, 6) AS recall, round(CAST(total_pos AS DOUBLE) / total_n, 6) AS prevalence FROM ranked""",
    ),
)
def pr_curve(spark, sf):
    return R.pr_curve(ranked(spark, sf), ARM)


@query(
    "o4_top_budget_review",
    with_views(
        RANKED,
        f"""SELECT s.provider, s.trace_id, round(s.score, 6) AS score, CAST(r.before_n + 1 AS BIGINT) AS rank,
        round(CAST(least({K.format(b='5e-2')} - r.before_n, r.n) AS DOUBLE) / r.n, 6) AS tie_share
        FROM scored s JOIN ranked r ON s.provider = r.provider AND s.score = r.score WHERE r.before_n < {K.format(b='5e-2')}""",
    ),
)
def top_budget(spark, sf):
    rows = scored(spark, sf, "").select("provider", "trace_id", "score", "y")
    table = R.ranked_groups(R.score_groups(rows, ARM), ARM)
    return R.top_budget_review(table, rows, ARM, 0.05).select("provider", "trace_id", "score", "rank", "tie_share")


@query(
    "a33_prior_shift",
    with_views(
        SCORED,
        f""", c AS (SELECT provider, {CONFUSION.format(f='score >= threshold')} FROM scored GROUP BY provider),
        d AS (SELECT *, {RATES} FROM c)
        SELECT provider, pi AS prevalence, round(CASE WHEN pi * recall + (1e0 - pi) * fpr > 0 THEN pi * recall / (pi * recall + (1e0 - pi) * fpr) END, 6) AS projected_precision,
        fpr = 0 AS degenerate FROM d, (VALUES (1e-2), (5e-2), (1e-1)) AS v(pi)""",
    ),
)
def prior_shift(spark, sf):
    return R.prior_shift(R.confusion(scored(spark, sf, ""), ARM, F.col("threshold")), ARM)


@query(
    "a12_repeat_stability",
    with_views(
        "predictions",
        """, c AS (SELECT provider, trace_id, predicted_label, count(*) AS k FROM predictions WHERE predicted_label IS NOT NULL GROUP BY ALL),
        m AS (SELECT provider, trace_id, max(k) AS modal, sum(k) AS labelled FROM c GROUP BY ALL),
        g AS (SELECT provider, trace_id, count(*) AS size, count(primary_score) AS scores, var_pop(primary_score) AS v FROM predictions GROUP BY ALL)
        SELECT g.provider, CAST(max(size) AS BIGINT) AS max_repeats,
        round(avg(CASE WHEN size >= 2 THEN CAST(modal AS DOUBLE) / labelled END), 6) AS mean_label_agreement,
        round(avg(CASE WHEN size >= 2 AND scores >= 2 THEN v END), 6) AS mean_score_variance
        FROM g LEFT JOIN m ON g.provider = m.provider AND g.trace_id = m.trace_id GROUP BY g.provider""",
    ),
)
def stability(spark, sf):
    return O.repeat_stability(corpus.view(spark, sf, "predictions"), ARM)


@query(
    "a19_latency_summary",
    with_views(
        "predictions",
        """SELECT provider, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
        round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, round(avg(latency_ms), 6) AS mean_ms, round(sum(latency_ms) / 1e3, 6) AS total_s,
        round(count(*) / (sum(latency_ms) / 1e3), 6) AS throughput_per_s FROM predictions WHERE latency_ms > 0 GROUP BY provider""",
    ),
)
def latency(spark, sf):
    return O.latency_summary(corpus.view(spark, sf, "predictions"), ARM)


@query(
    "a20_p11_operational_summary",
    with_views(
        "prices predictions priced",
        """SELECT provider, count(*) AS n_predictions, count(error) AS error_count, round(count(error) / CAST(count(*) AS DOUBLE), 6) AS error_rate,
        count(*) FILTER (WHERE contains(error, 'ParseFailure')) AS parse_failure_count, CAST(sum(greatest(0, n_attempts - 1)) AS BIGINT) AS retry_count,
        CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
        round(sum(cost_usd), 6) AS total_cost_usd, count(*) - count(cost_usd) AS cost_unpriced_predictions FROM priced GROUP BY provider""",
    ),
)
def operational(spark, sf):
    return O.operational_summary(priced(spark, sf), ARM)


def priced(spark, sf):
    rows = J.price_join(corpus.view(spark, sf, "predictions"), corpus.view(spark, sf, "prices"))
    return O.with_cost(rows)


@query(
    "a1_prevalence",
    with_views(
        "truth",
        """, l AS (SELECT * FROM (VALUES ('supported_success'), ('unsupported_success'), ('reported_failure_or_uncertainty'), ('no_success_claim')) AS v(label))
        SELECT l.label, count(t.label) AS n, round(count(t.label) / CAST(greatest((SELECT count(*) FROM truth), 1) AS DOUBLE), 6) AS share
        FROM l LEFT JOIN truth t ON l.label = t.label GROUP BY l.label""",
    ),
)
def prevalence(spark, sf):
    return O.prevalence(corpus.view(spark, sf, "truth"))


@query(
    "a2_label_fault_counts",
    with_views(
        "truth",
        """SELECT 'fault' AS kind, fault_type AS name, count(*) AS n FROM truth GROUP BY fault_type UNION ALL
        SELECT 'label', v.name, count(t.label) FROM (VALUES ('supported_success'), ('unsupported_success'), ('reported_failure_or_uncertainty'), ('no_success_claim')) AS v(name)
        LEFT JOIN truth t ON t.label = v.name GROUP BY v.name""",
    ),
)
def label_counts(spark, sf):
    return O.label_fault_counts(corpus.view(spark, sf, "truth"))


@query(
    "w1_point_predictions",
    with_views("predictions zero_repeat points", "SELECT provider, trace_id, repeat_no, model_id, round(primary_score, 6) AS primary_score FROM points"),
)
def point_rows(spark, sf):
    return points(spark, sf).select("provider", "trace_id", "repeat_no", "model_id", "primary_score")


@query(
    "j1_p4_score_join",
    with_views(SCORED, "SELECT provider, trace_id, label, y, round(score, 6) AS score FROM scored"),
)
def score_join(spark, sf):
    truth = corpus.view(spark, sf, "truth").drop("ord")
    return J.score_join(points(spark, sf), truth).select("provider", "trace_id", "label", "y", "score")


@query(
    "v7_join_integrity",
    with_views(
        "truth predictions",
        "SELECT p.provider, p.trace_id FROM predictions p ANTI JOIN (SELECT * FROM truth WHERE split = 'test') t ON p.trace_id = t.trace_id",
    ),
)
def join_integrity(spark, sf):
    truth = corpus.view(spark, sf, "truth").where("split = 'test'")
    return J.unmatched_predictions(corpus.view(spark, sf, "predictions"), truth).select("provider", "trace_id")


@query(
    "x4_metric_by_name",
    with_views(
        RANKED,
        f"""SELECT provider, 'auprc' AS metric, round({AP}, 6) AS value FROM ranked GROUP BY provider UNION ALL
        SELECT provider, 'auroc', round({ROC}, 6) FROM ranked GROUP BY provider UNION ALL
        SELECT provider, 'recall_at_budget', round({recall_sql('5e-2')}, 6) FROM ranked GROUP BY provider""",
    ),
)
def metric_by_name(spark, sf):
    names = sorted(R.METRICS)
    wide = ranked(spark, sf).groupBy("provider").agg(*[R.metric_by_name(m).alias(m) for m in names])
    return wide.unpivot("provider", names, "metric", "value")
