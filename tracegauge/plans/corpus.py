"""Evaluation tables derived from the driver's tables.

Each view is one SQL text that Spark and the check engine read alike, so that a query
and its check start from the same rows. Every view is a projection or aggregate of a
given table and grows with it: an order is a trace, a line item is a prediction, a
supplier is a run, a part is a priced model, a customer is a split unit, an event row
is a trace event, a document is a trace text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

PROVIDERS = ("rules", "linear", "boosted", "typed", "general")
FREE = ("rules", "linear", "boosted")
THRESHOLDS = {"rules": 0.5, "linear": 0.55, "typed": 0.6}
DEFAULT_THRESHOLD = 0.5
DATASET = "ds1"

_HEX = "md5(CAST({0} AS STRING))"

VIEWS: dict[str, str] = {
    "truth": """
SELECT concat('order/', CAST(o_orderkey AS STRING)) AS trace_id, o_orderkey AS ord,
       concat('dom_', CAST(o_custkey % 8 AS STRING)) AS domain,
       concat('task_', CAST(o_custkey AS STRING)) AS template_family,
       CASE WHEN o_orderkey * 7919 % 1000 < 300 THEN 'unsupported_success'
            WHEN o_orderkey * 7919 % 1000 < 700 THEN 'supported_success'
            WHEN o_orderstatus = 'P' THEN 'no_success_claim'
            ELSE 'reported_failure_or_uncertainty' END AS label,
       concat('fault_', substr(o_orderpriority, 1, 1)) AS fault_type,
       CASE WHEN o_custkey % 5 < 3 THEN 'dev' WHEN o_custkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split
FROM {orders}""",
    "predictions": """
SELECT trace_id, ord, provider, run_id, model_id, repeat_no, arrival, error,
       CASE WHEN error IS NULL THEN score END AS primary_score,
       CASE WHEN error IS NOT NULL THEN NULL WHEN score >= 5e-1 THEN 'unsupported_success'
            WHEN l_partkey % 3 = 0 THEN 'no_success_claim' WHEN l_partkey % 7 < 5 THEN 'supported_success'
            ELSE 'reported_failure_or_uncertainty' END AS predicted_label,
       CASE WHEN error IS NULL AND provider <> 'rules' THEN abs(score - 5e-1) * 2e0 END AS confidence,
       CASE WHEN error IS NULL THEN 1 + CAST(l_partkey % 20 = 0 AS INT) ELSE 3 END AS n_attempts,
       CASE WHEN provider = 'rules' AND l_partkey % 4 = 0 THEN 0e0 ELSE l_extendedprice / 1e2 END AS latency_ms,
       CASE WHEN error IS NULL THEN 200 + CAST(floor(l_quantity) AS BIGINT) * 10 END AS input_tokens,
       CASE WHEN error IS NULL THEN l_partkey % 300 END AS output_tokens
FROM (
  SELECT concat('order/', CAST(l_orderkey AS STRING)) AS trace_id, l_orderkey AS ord, provider, l_partkey, l_quantity, l_extendedprice,
         concat('run_', CAST(l_suppkey AS STRING)) AS run_id, concat('model_', CAST(l_partkey AS STRING)) AS model_id,
         CAST(l_partkey % 3 AS INT) AS repeat_no,
         (l_orderkey * 8 + l_linenumber) * 4000000 + (l_partkey * 2011 + l_suppkey + CAST(floor(l_extendedprice) AS BIGINT) * 7) % 4000000 AS arrival,
         CASE provider
           WHEN 'rules' THEN CAST(floor(CAST((1000 - z) * 6 + noise * 4 AS DOUBLE) / 1e3) AS BIGINT) / 1.1e1
           WHEN 'linear' THEN CAST((1000 - z) * 6 + noise * 4 AS DOUBLE) / 1.01e4
           WHEN 'boosted' THEN CAST((1000 - z) * 8 + noise * 2 AS DOUBLE) / 1.01e4
           WHEN 'typed' THEN (CAST((1000 - z) * 7 AS DOUBLE) / 1e3 + 3e0 * l_extendedprice / 1.1e5) / 1e1
           ELSE (CAST((1000 - z) * 3 AS DOUBLE) / 1e3 + 7e0 * l_extendedprice / 1.1e5) / 1e1 END AS score,
         CASE WHEN provider IN ('typed', 'general') AND l_returnflag = 'R' AND l_partkey % 9 = 0
              THEN CASE WHEN l_partkey % 2 = 0 THEN 'ParseFailureError: not JSON' ELSE 'HTTP 429 after 3 attempts' END END AS error
  FROM (SELECT *, l_orderkey * 7919 % 1000 AS z,
               (l_partkey * 31 + l_suppkey * 17 + CAST(floor(l_extendedprice) AS BIGINT)) % 1009 AS noise,
               CASE l_suppkey % 5 WHEN 0 THEN 'rules' WHEN 1 THEN 'linear' WHEN 2 THEN 'boosted' WHEN 3 THEN 'typed' ELSE 'general' END AS provider
        FROM {lineitem}) l) p""",
    "runs": """
SELECT concat('run_', CAST(s_suppkey AS STRING)) AS run_id,
       CASE s_suppkey % 5 WHEN 0 THEN 'rules' WHEN 1 THEN 'linear' WHEN 2 THEN 'boosted' WHEN 3 THEN 'typed' ELSE 'general' END AS provider,
       concat('model_', CAST(s_suppkey AS STRING)) AS model_id,
       CASE WHEN s_nationkey % 3 = 0 THEN 'dev' ELSE 'test' END AS split,
       CASE WHEN s_nationkey % 5 = 0 THEN 'old' ELSE 'ds1' END AS dataset_id,
       concat('2026-09-', lpad(CAST(1 + s_nationkey AS STRING), 2, '0'), 'T00:00:00Z') AS created_utc,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL
            ELSE concat('2026-09-', lpad(CAST(1 + s_nationkey AS STRING), 2, '0'), 'T00:', lpad(CAST(1 + s_suppkey % 50 AS STRING), 2, '0'), ':00Z') END AS updated_utc,
       CASE WHEN s_suppkey % 7 = 0 THEN 'running' ELSE 'complete' END AS status,
       CAST(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS INT) AS concurrency
FROM {supplier}""",
    "prices": """
SELECT concat('model_', CAST(p_partkey AS STRING)) AS model_id,
       CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE CAST(p_size AS DOUBLE) / 1e1 END AS in_rate,
       CASE WHEN p_partkey % 10 = 8 THEN NULL ELSE p_retailprice / 1e3 END AS out_rate,
       p_partkey % 13 <> 0 AS verified
FROM {part}""",
    "split_unit": """
SELECT DISTINCT concat('task_', CAST(o_custkey AS STRING)) AS template_family,
       CASE WHEN o_custkey % 5 < 3 THEN 'dev' WHEN o_custkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split
FROM {orders}""",
    "trace_events": """
SELECT concat(CAST(user_id AS STRING), '/', CAST(CAST(date_trunc('week', ts) AS DATE) AS STRING)) AS trace_id,
       event_id AS seq,
       CASE event_type WHEN 'click' THEN 'assistant_tool_call' WHEN 'signup' THEN 'assistant_message' ELSE 'tool_result' END AS type,
       CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN 'get_record' ELSE 'update_record' END AS tool,
       CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok'
            WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'timeout' ELSE 'pending' END END AS status,
       CASE WHEN event_type = 'click' THEN props END AS arguments,
       CASE WHEN event_type IN ('view', 'purchase', 'error') AND NOT (event_type = 'error' AND event_id % 3 = 1) THEN props END AS data,
       CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'Done - the record is now set.'
            WHEN 1 THEN 'I could not update the record.' WHEN 2 THEN 'Which option should I use?'
            ELSE 'The change has been confirmed.' END END AS text,
       value AS latency_ms
FROM {events}""",
    "curve_points": """
SELECT provider, n_train, seed, 39 AS n_calibration,
       (base + CAST(sum(q) % 80 AS DOUBLE)) / 1e3 AS auprc
FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'linear' ELSE 'boosted' END AS provider,
             CAST(l_partkey % 5 AS INT) AS seed, CAST(floor(l_quantity) AS BIGINT) AS q,
             CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 25 WHEN 3 THEN 50 WHEN 4 THEN 100 WHEN 5 THEN 200 WHEN 6 THEN 400 ELSE 800 END AS n_train,
             (CASE l_linenumber WHEN 1 THEN 600 WHEN 2 THEN 700 WHEN 3 THEN 690 WHEN 4 THEN 780 WHEN 5 THEN 830 WHEN 6 THEN 860 ELSE 880 END
              + CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 40 END) * 1e0 AS base
      FROM {lineitem}) c
GROUP BY provider, n_train, seed, base""",
    "doc_truth": """
SELECT concat('doc/', CAST(l.doc_id AS STRING)) AS trace_id, l.doc_id AS ord, d.lang AS domain, d.source AS template_family,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'supported_success'
            WHEN l.quality = 0 AND l.toxic = 0 THEN 'unsupported_success'
            WHEN l.quality = 1 AND l.toxic = 1 THEN 'reported_failure_or_uncertainty'
            ELSE 'no_success_claim' END AS label,
       concat('len_', CASE WHEN d.n_chars < 300 THEN 's' WHEN d.n_chars < 1500 THEN 'm' ELSE 'l' END) AS fault_type,
       d.n_chars
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the parquet files of ``sf_dir``."""
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spread(base(spark, sf_dir, t)) for t in used})


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: str, body: str) -> str:
    """Check SQL: the named views as WITH clauses before ``body``."""
    parts = []
    for name in names.split():
        text = VIEWS[name] if name in VIEWS else SHARED[name]
        parts.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return "WITH " + ",\n".join(parts) + "\n" + body


# Check-side steps that several checks share (plain SQL over the views above).
SHARED: dict[str, str] = {
    "thresholds": "SELECT * FROM (VALUES ('rules', 5e-1), ('linear', 5.5e-1), ('typed', 6e-1), ('boosted', 5e-1), ('general', 5e-1)) AS t(provider, threshold)",
    "zero_repeat": "SELECT provider, bool_or(repeat_no = 0) AS has_zero FROM predictions GROUP BY provider",
    "points": """
SELECT * FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.provider, p.trace_id
             ORDER BY CASE WHEN z.has_zero THEN -p.arrival ELSE p.arrival END) AS rn
  FROM predictions p JOIN zero_repeat z ON p.provider = z.provider
  WHERE p.repeat_no = 0 OR NOT z.has_zero) q WHERE rn = 1""",
    "scored": """
SELECT p.provider, p.trace_id, p.ord, t.label, t.fault_type, t.domain, t.template_family, t.split,
       CASE WHEN t.label = 'unsupported_success' THEN 1 ELSE 0 END AS y, p.primary_score AS score,
       p.predicted_label, p.confidence, p.latency_ms, p.model_id, p.input_tokens, p.output_tokens, h.threshold
FROM points p JOIN truth t ON p.trace_id = t.trace_id JOIN thresholds h ON p.provider = h.provider
WHERE p.primary_score IS NOT NULL""",
    "groups": "SELECT provider, score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY provider, score",
    "ranked": """
SELECT *, sum(n) OVER w - n AS before_n, sum(pos) OVER w - pos AS before_pos,
       sum(n) OVER (PARTITION BY provider) AS total_n, sum(pos) OVER (PARTITION BY provider) AS total_pos
FROM groups WINDOW w AS (PARTITION BY provider ORDER BY score DESC)""",
    "flags": "SELECT *, score >= threshold AS hit FROM scored",
    "priced": """
SELECT p.*, CASE WHEN p.input_tokens IS NOT NULL AND r.verified AND r.in_rate IS NOT NULL AND r.out_rate IS NOT NULL
            THEN (p.input_tokens * r.in_rate + p.output_tokens * r.out_rate) / 1e6 END AS cost_usd
FROM predictions p LEFT JOIN prices r ON p.model_id = r.model_id""",
}
SCORED = "truth predictions thresholds zero_repeat points scored"
RANKED = SCORED + " groups ranked"
