"""The registered queries beside their check SQL, and the shape of their plans."""

import re

import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, engine
from tracegauge.plans import scoring

# One query per operator family; tests/compare.py runs all of them.
CHECKED = (
    "a3_threshold_grid", "a5_auroc", "a7_ece", "a9_a10_recall_at_budget", "a12_repeat_stability", "a14_detection_groups",
    "a20_p11_operational_summary", "a22_cost_block", "a24_speed_by_arm", "a29_a31_paired_bootstrap", "a36_j6_s16_audit_agreement",
    "a38_curve_summary", "a41_kpis", "f3_table_fingerprint", "f6_terminal_status", "f7_f8_f9_label_rule", "f21_elision_plan",
    "f27_parse_structured_reply", "f35_f36_make_splits", "j9_missed_by_all", "m2_j11_j12_evidence_signals", "m4_word_tfidf",
    "o4_top_budget_review", "p2_leakage_scan", "p5_public_rows", "s9_run_headers", "t3_live_snapshot", "u3_fault_gaps",
    "v1_validate_dataset", "v2_v3_verify_runs", "w1_point_predictions", "w6_m13_crossover", "w8_w9_m11_label_budget_subsample", "w12_error_rate_guard",
)


@pytest.fixture(scope="module")
def check_engine():
    return engine(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_check(spark, check_engine, name):
    assert compare(spark, check_engine, SF, name, queries()[name], oracle_sql()[name]) is None


def test_entry_has_a_stable_schema(spark):
    df = entry(spark)
    assert df.columns[:3] == ["provider", "n", "positives"] and df.count() == 5


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_plan_has_no_single_task_window_and_no_python(spark):
    plan = plan_of(scoring.ranking_metrics(spark, SF))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan
    # The only window over a whole arm is the one over its coarse cells.
    ordered = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
    assert ordered and sum("_cell" not in keys for keys in ordered) <= 2


def test_scan_reads_only_what_the_metric_needs(spark):
    plan = plan_of(queries()["a1_prevalence"](spark, SF))
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_totalprice" not in scan and "o_orderdate" not in scan


def test_filters_reach_the_scan(spark):
    plan = plan_of(queries()["a25_truncation_summary"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(n_chars,1000\)", plan)


@pytest.mark.parametrize("name", ["a14_detection_groups", "a41_kpis", "j9_missed_by_all", "w12_error_rate_guard", "a22_cost_block"])
def test_no_cross_products(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scored_rows_hold_what_the_query_names(spark):
    """F24, F25, F29 to F31: points are folded and written with the named columns only."""
    base = {"provider", "trace_id", "repeat_no", "arrival", "score", "label", "y", "threshold"}
    assert set(scoring.scored(spark, SF, "").columns) == base
    assert set(scoring.scored(spark, SF, "ord confidence", "fault_type").columns) == base | {"ord", "confidence", "fault_type"}


def test_chat_reply_numbers_are_taken_out_once(spark):
    """eight numbers, each read by two checks and by the result."""
    plan = queries()["f28_parse_chat_reply"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") <= 12
