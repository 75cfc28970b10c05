"""Runs, prices, accounts, sheets, verification and the entry contract."""

import pytest
from pyspark.sql import functions as F

from tracegauge.functions import text as X
from tracegauge.operators import audit as A, detectors as D, joins as J, runs as N, sets as U, verify as V
from tracegauge.schemas import DEVIATION, PREDICTION, REAL_FAULTS, SYNTHETIC_FAULTS, TRUNCATION, IntegrityError
from tracegauge.sources import traces as TR

PRICES = "model_id string, in_rate double, out_rate double, verified boolean"


def predictions(spark, note="fine", n=3):
    rows = [
        {"run_id": "r1", "trace_id": f"t{i}", "provider": "p", "model_id": "m", "repeat_no": 0, "primary_score": 0.5, "input_tokens": 1_000_000, "output_tokens": 0,
         "error": note, "attempts": [{"attempt_number": k + 1, "http_status": 200, "error_class": None, "retry_delay_seconds": 0.0, "latency_ms": 1.0} for k in range(i)]}
        for i in range(n)
    ]
    return spark.createDataFrame(rows, PREDICTION)


def test_run_is_priced_redacted_and_written_once(spark, tmp_path):
    secret = "correct-horse-battery"
    prices = spark.createDataFrame([("m", 2.0, 0.0, True)], PRICES)
    TR.write_run(predictions(spark, f"saw {secret}"), prices, X.secret_table(spark, [secret]), f"{tmp_path}/run")
    back = spark.read.parquet(f"{tmp_path}/run/predictions")
    assert {r["cost_usd"] for r in back.collect()} == {2.0}
    assert {r["error"] for r in back.collect()} == {"saw [REDACTED]"}
    assert spark.read.parquet(f"{tmp_path}/run/attempts").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        TR.write_run(predictions(spark), prices, X.secret_table(spark, [secret]), f"{tmp_path}/run")


def test_files_of_many_runs_follow_their_size(spark, tmp_path):
    rows = predictions(spark, n=100).withColumn("run_id", F.concat(F.lit("r"), F.element_at(F.split("trace_id", "t"), -1)))
    prices = spark.createDataFrame([("m", 2.0, 0.0, True)], PRICES)
    TR.write_run(rows, prices, X.secret_table(spark, ["correct-horse-battery"]), f"{tmp_path}/run")
    for name, n in (("predictions", 100), ("attempts", 4950)):
        assert len(list((tmp_path / "run" / name).rglob("*.parquet"))) <= 8
        back = spark.read.parquet(f"{tmp_path}/run/{name}")
        assert back.count() == n
        # a run's rows are in neighbouring ranges: most runs are in one file
        files = back.select("run_id", F.input_file_name().alias("file")).distinct().groupBy("run_id").agg(F.count("file").alias("files"))
        assert files.where("files > 1").count() <= 8


def test_surviving_secret_stops_the_write(spark, tmp_path):
    # The text reads "1.5" only once the number is turned into JSON, past any column scrub.
    prices = spark.createDataFrame([("m", 2.0, 0.0, True)], PRICES)
    hidden = predictions(spark).withColumn("latency_ms", F.lit(12345678.5))
    with pytest.raises(IntegrityError):
        TR.write_run(hidden, prices, X.secret_table(spark, ["1.23456785E7"]), f"{tmp_path}/run")


def test_strict_price_join_refuses_unknown_models(spark):
    prices = spark.createDataFrame([("other", 1.0, 1.0, True)], PRICES)
    assert J.price_join(predictions(spark), prices).where("in_rate IS NULL").count() == 3
    with pytest.raises(IntegrityError):
        J.price_join(predictions(spark), prices, strict=True)


def test_accounts_tell_empty_from_unknown(spark, tmp_path):
    TR.write_accounts(spark.createDataFrame([], TRUNCATION), spark.createDataFrame([], DEVIATION), f"{tmp_path}/acc")
    assert TR.read_account(spark, f"{tmp_path}/acc", "truncations").count() == 0
    assert TR.read_account(spark, f"{tmp_path}/nowhere", "truncations") is None


def test_provenance_is_optional(spark, tmp_path):
    schema = "struct<dataset_id:string,n_records:bigint>"
    assert TR.load_provenance(spark, f"{tmp_path}/none.json", schema).count() == 0
    (tmp_path / "p.json").write_text('{"dataset_id":"d",\n"n_records":5}')
    assert TR.load_provenance(spark, f"{tmp_path}/p.json", schema).first()["n_records"] == 5


def test_sheets_round_trip(spark, tmp_path):
    events = "array<struct<seq:int,type:string,tool:string,arguments:string,status:string,data:string,text:string>>"
    traces = spark.createDataFrame([("t1", "d", "f", "g, \"x\"", [(0, "assistant_message", None, None, None, None, "line\ntwo")], "no_success_claim", "none")],
                                   f"trace_id string, domain string, template_family string, goal string, events {events}, label string, fault_type string")
    sample = traces.select("trace_id")
    TR.write_sheet(TR.blind_sheet(traces, sample), f"{tmp_path}/blind")
    back = TR.read_sheet(spark, f"{tmp_path}/blind")
    assert not {"label", "fault_type"} & set(back.columns)
    row = back.first()
    assert row["rendered_trace"] == 'GOAL: g, "x" | ASSISTANT: line\ntwo' and row["auditor_label"] == "" and row["in_sample"] == "TRUE"
    assert A.audit_status(back).first()["status"] == "not_performed"
    assert A.audit_status(None, spark).first()["status"] == "sheet_missing"


def test_agreement_keeps_rows_without_a_key(spark):
    key = spark.createDataFrame([("t1", "a", "f", "u", "a/f", "TRUE"), ("t2", "b", "f", "u", "b/f", "TRUE")], "trace_id string, label string, fault_type string, template_family string, audit_stratum string, in_sample string")
    sheet = spark.createDataFrame([("t1", "a", "x"), ("gone", "a", "x"), ("t2", "", "y")], "trace_id string, auditor_label string, auditor_id string")
    row = A.audit_agreement(sheet, key).first()
    assert (row["n_audited"], row["agreement"], row["n_without_key"], row["n_auditors"]) == (2, 0.5, 1, 1)
    assert {r["audit_stratum"]: r["audited"] for r in A.audit_strata(sheet, key).collect()} == {"a/f": 1, "b/f": 0}


def test_price_chain_finds_a_reprice(spark):
    rows = [("m", "2026-09-19", 1, 1.0, 1.0), ("m", "2026-09-20", 1, 1.0, 1.0), ("m", "2026-09-20", 2, 1.5, 1.0), ("new", "2026-09-20", 2, 9.0, 9.0)]
    prices = spark.createDataFrame(rows, "model_id string, manifest_date string, revision int, in_rate double, out_rate double")
    got = V.price_chain(prices).collect()
    assert [(r["model_id"], r["old_in_rate"], r["in_rate"]) for r in got] == [("m", 1.0, 1.5)]


def test_run_verification(spark):
    columns = "run_id string, n_predictions bigint, total_input_tokens bigint, total_cost_usd double"
    good = [("a", 3, 30, 1.0), ("b", 3, 30, None), ("c", 3, 30, 2.0), ("d", 3, 30, 2.0)]
    stored = spark.createDataFrame([("a", 3, 30, 1.0), ("b", 2, 30, None), ("c", 3, 31, 2.5), ("d", 3, 30, None)], columns)
    got = sorted(tuple(r) for r in V.rollup_problems(stored, spark.createDataFrame(good, columns)).collect())
    assert got == [("b", "n_predictions"), ("c", "total_cost"), ("c", "total_input_tokens"), ("d", "total_cost_missing")]


def test_dataset_validation_on_both_kinds(spark):
    rows = [("t1", "u1", "no_success_claim", f) for f in REAL_FAULTS[:5]] + [("t9", "u2", "supported_success", SYNTHETIC_FAULTS[0])]
    truth = spark.createDataFrame(rows, "trace_id string, template_family string, label string, fault_type string")
    units = spark.createDataFrame([("u1", "dev"), ("u1", "test")], "template_family string, split string")
    got = {(r["check"], r["severity"]) for r in V.validate_dataset(truth, units, REAL_FAULTS, real=True).collect()}
    assert got == {("label_balance", "note"), ("fault_missing", "fail"), ("fault_foreign", "fail"), ("split_overlap", "fail"),
                   ("uncovered_unit", "fail"), ("one_label_unit", "note"), ("duplicate_id", "fail")}


def test_fit_guard(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u2", "b")], "template_family string, label string")
    none = spark.createDataFrame([], "template_family string")
    U.fit_guard(rows, rows, none)
    with pytest.raises(IntegrityError):
        U.fit_guard(rows, rows, rows.select("template_family").limit(1))
    with pytest.raises(IntegrityError):
        U.fit_guard(rows.where("label = 'a'"), rows, none)
    with pytest.raises(IntegrityError):
        U.fit_guard(rows, rows.limit(0), none)


def test_python_detector_never_sees_truth(spark):
    import pandas as pd

    def nosy(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": batch["trace_id"], "seen": ",".join(sorted(batch.columns))})

    D.register_python_detector("nosy", nosy, "trace_id string, seen string")
    traces = spark.createDataFrame([("t1", "g", "positive", "f", "{}")], "trace_id string, goal string, label string, fault_type string, oracle string")
    got = D.run_predictions("nosy", traces, 2).collect()
    assert {r["seen"] for r in got} == {"goal,repeat_no,trace_id"} and sorted(r["repeat_no"] for r in got) == [0, 1]
    with pytest.raises(ValueError):
        D.register_python_detector("nosy", nosy)


def test_detector_runs_anew_for_each_repeat_and_views_are_scanned(spark):
    D.register_detector("wavering", lambda view: view.select("trace_id", (F.length("goal") + F.col("repeat_no")).alias("primary_score")))
    traces = spark.createDataFrame([("t1", "g", "{}"), ("t2", "gg", '{"label": 1}')], "trace_id string, goal string, notes string")
    got = D.run_predictions("wavering", traces, 3)
    assert sorted(tuple(r) for r in got.select("trace_id", "repeat_no", "primary_score").collect()) == [("t1", 0, 1), ("t1", 1, 2), ("t1", 2, 3), ("t2", 0, 2), ("t2", 1, 3), ("t2", 2, 4)]
    leaky = traces.withColumn("events", F.array(F.struct(F.lit("x").alias("oracle"))))
    with pytest.raises(IntegrityError):
        D.run_predictions("wavering", leaky, 1)
    with pytest.raises(IntegrityError):
        D.run_predictions("wavering", traces, 1, extra_json="notes")


def test_recent_errors_are_per_key(spark):
    rows = [("a", f"t{i}", "boom", i) for i in range(12)] + [("b", "t", "boom", 3), ("b", "u", None, 4)]
    got = N.recent_errors(spark.createDataFrame(rows, "run_id string, trace_id string, error string, arrival bigint"), ["run_id"])
    assert sorted((r["run_id"], r["arrival"]) for r in got.collect()) == [("a", i) for i in range(4, 12)] + [("b", 3)]


def test_error_guard_by_arrival(spark):
    rows = [("r", i, "boom" if i in (3, 21) else None) for i in range(40)] + [("few", i, "boom") for i in range(5)]
    df = spark.createDataFrame(rows, "run_id string, arrival bigint, error string")
    assert [tuple(r) for r in N.error_rate_guard(df, ["run_id"]).collect()] == [("r", 22, 2)]


def test_headers_prefer_the_manifest(spark):
    m = spark.createDataFrame([("a", "p", "2026-01-02", "x")], "run_id string, provider string, created_utc string, model_id string")
    p = spark.createDataFrame([("a", "q", "2026-01-09", "failed"), ("b", "q", "2026-01-03", "running")], "run_id string, provider string, created_utc string, status string")
    got = [(r["run_id"], r["provider"], r["status"]) for r in N.newest_first(N.run_headers(m, p)).collect()]
    assert got == [("b", "q", "running"), ("a", "p", "failed")]
