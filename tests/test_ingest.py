"""Reading a miniature release, labels, licences, provenance."""

import json

import pytest
from pyspark.sql import functions as F

from tracegauge.functions import labels as L
from tracegauge.operators import sampling as M
from tracegauge.schemas import IntegrityError
from tracegauge.sources import dims, release as R, traces as TR

CODE = "x = apis.mail.send(to=1)\napis.notes.list()\napis.supervisor.complete_task(status='{status}')"


def log(*pairs):
    out = "preamble ``` not a block\n"
    for i, (code, output) in enumerate(pairs, 1):
        out += f"\n### Environment Interaction {i}\n\n```python\n{code}\n```\n\n```\n{output}\n```\n"
    return out


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def task(split_dir, name, status, goal="do it", calls=("/mail/send", "/mail/send", "/notes/x", "/supervisor/y")):
    base = split_dir / "tasks" / name
    code = CODE.format(status=status) if status else "print(apis.notes.list())"
    put(base / "logs", "environment_io.md", log(("apis.mail.read()", "ok ü"), (code, "done")))
    put(base / "logs", "api_calls.jsonl", "\n".join([json.dumps({"method": "get", "url": u}) for u in calls] + ["", "not json", "[1]"]))
    insert = ["INSERT INTO tasks (id, instruction, note) VALUES (?, ?, ?)", [1, goal, 3], True]
    put(base / "dbs", "supervisor.jsonl", "broken INSERT INTO tasks\n" + json.dumps(["INSERT INTO other (a)", [1]]) + "\n" + (json.dumps(insert) if goal else "") + "\n")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark-release") / "outputs"
    split = base / R.ARCHITECTURES[0] / "vendor" / "model-x" / "test_normal"
    truth = {
        "aa_1": {"success": True, "difficulty": 1, "num_tests": 3, "passes": [1], "failures": []},
        "aa_2": {"success": False, "difficulty": 3, "num_tests": None, "failures": [{"a": 1}, {"b": 2}]},
        "bb_1": {"success": False, "difficulty": None, "num_tests": 1, "failures": []},
        "cc_1": {"success": False, "difficulty": 2, "num_tests": 1},
    }
    put(split / "evaluations", "test_normal.json", json.dumps({"individual": truth}))
    put(split / "evaluations", "other.json", "{}")
    task(split, "aa_1", "success")
    task(split, "aa_2", "Completed")
    task(split, "bb_1", "fail", calls=())
    task(split, "cc_1", None, calls=("/supervisor/only",))
    task(split, "dd_1", "success")  # no ground truth
    task(split, "ee_1", "success", goal="")
    put(split / "tasks" / "ff_1" / "logs", "environment_io.md", "nothing here")
    unscored = base / R.ARCHITECTURES[1] / "vendor" / "model-y" / "dev"
    task(unscored, "aa_1", "success")
    task(base / "another_agent" / "vendor" / "m" / "test_normal", "zz_1", "success")
    return str(base)


@pytest.fixture(scope="module")
def licences(spark):
    return spark.createDataFrame([("corpus", True), ("unclear", False)], "corpus string, permits_this_use boolean")


def test_release_becomes_labelled_traces(spark, root, licences):
    traces, counts = R.ingest(spark, root, "corpus", licences)
    got = {r["trace_id"]: r for r in traces.collect()}
    prefix = f"corpus/{R.ARCHITECTURES[0]}/model-x/test_normal/"
    assert {t.removeprefix(prefix): (r["label"], r["fault_type"]) for t, r in got.items()} == {
        "aa_1": ("supported_success", "real_supported_completion"),
        "aa_2": ("unsupported_success", "real_unsupported_completion_hard"),
        "bb_1": ("reported_failure_or_uncertainty", "real_reported_failure"),
        "cc_1": ("no_success_claim", "real_no_completion_claim"),
    }
    assert counts.first().asDict() == {"seen": 6, "kept": 4, "dropped_no_goal": 1, "dropped_no_ground_truth": 1}
    one = got[prefix + "aa_1"]
    assert one["template_family"] == "aa" and one["goal"] == "do it" and one["domain"] == "mail"
    assert [e["seq"] for e in one["events"]] == [0, 1, 2, 3, 4]
    assert json.loads(one["events"][1]["data"]) == {"output": "ok ü"}
    assert one["events"][-1]["text"] == CODE.format(status="success")
    assert [t["name"] for t in one["tool_schema"]] == ["mail.read", "mail.send", "notes.list", "supervisor.complete_task"]
    oracle = json.loads(got[prefix + "aa_2"]["oracle"])
    assert oracle["n_failed_tests"] == 2 and oracle["num_tests"] == 0 and oracle["n_api_calls"] == 4
    assert got[prefix + "bb_1"]["domain"] == "mail"  # from code: one call each, first by name
    assert got[prefix + "cc_1"]["domain"] == "mail"


def test_ingest_is_refused_without_a_licence(spark, root, licences):
    for name in ("unclear", "unheard_of"):
        with pytest.raises(IntegrityError):
            R.ingest(spark, root, name, licences)


def test_unknown_architectures_are_named(spark, root, licences):
    with pytest.raises(IntegrityError, match="another_agent"):
        R.source_rows(spark, root, ("missing",))


def test_last_status_wins(spark):
    shape = "array<struct<code:string,output:string>>"
    rows = spark.createDataFrame(
        [([("complete_task(status='fail')", ""), ("complete_task(status=\"success\")\ncomplete_task()", "")],), ([("complete_task()", "")],)], f"i {shape}"
    )
    assert [r[0] for r in rows.select(R.terminal_status(F.col("i"))).collect()] == ["success", None]


def test_unrecognised_claim_is_refused(spark):
    rows = spark.createDataFrame([("maybe",)], "s string").withColumn("claim", L.normalise_claim(F.col("s")))
    with pytest.raises(IntegrityError):
        L.refuse_unknown_claims(rows)


def test_provenance_and_splits(spark, root, licences):
    traces, counts = R.ingest(spark, root, "corpus", licences)
    splits = M.make_splits(traces, 1)
    row = R.provenance_row(traces, counts, splits, "corpus", "real").first()
    assert row["label_counts"]["no_success_claim"] == 1 and row["seen"] == 6
    assert row["split_sizes"] == {"dev": 1, "validation": 1, "test": 1}


def test_traces_survive_export_and_closed_schema(spark, root, licences, tmp_path):
    traces, _ = R.ingest(spark, root, "corpus", licences)
    TR.export_traces(traces, f"{tmp_path}/out")
    back = TR.read_traces(spark, f"{tmp_path}/out")
    pick = lambda df: sorted((r["trace_id"], r["label"], len(r["events"])) for r in df.collect())
    assert pick(back) == pick(traces)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"trace_id":"x","surprise":1}\n')
    with pytest.raises(IntegrityError, match="surprise"):
        TR.read_traces(spark, str(bad))


def test_small_documents(spark, tmp_path):
    (tmp_path / "prices.json").write_text(json.dumps({"manifest_date": "2026-09-20", "currency": "USD", "models": {
        "m": {"input_usd_per_mtok": 0.5, "output_usd_per_mtok": None, "verified": True}, "n": {"input_usd_per_mtok": 1.0, "output_usd_per_mtok": 2.0}}}, indent=1))
    got = {r["model_id"]: r for r in dims.load_prices(spark, f"{tmp_path}/prices.json").collect()}
    assert got["m"]["out_rate"] is None and got["m"]["verified"] and not got["n"]["verified"]
    (tmp_path / "splits.json").write_text(json.dumps({"seed": 1, "dev": ["a", "b"], "validation": ["c"], "test": ["d"]}))
    units = dims.load_splits(spark, f"{tmp_path}/splits.json")
    assert sorted((r["template_family"], r["split"]) for r in units.collect()) == [("a", "dev"), ("b", "dev"), ("c", "validation"), ("d", "test")]
    with pytest.raises(ValueError):
        dims.units_of(units, "holdout")


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_byte_ranges_read_what_whole_files_hold(spark, root, size):
    from tracegauge.sources import release_files as S

    pick = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    whole = S.read_files(spark, root, R.ARCHITECTURES)
    assert whole.rdd.getNumPartitions() == 1
    cut = S.read_files(spark, root, R.ARCHITECTURES, size)
    assert pick(cut) == pick(whole)
    assert {r.kind for r in whole.collect()} == {"interaction", "call", "goal", "truth"}


def test_sections_that_only_look_like_headings_stay_text(spark, tmp_path):
    from tracegauge.sources import release_files as S

    at = f"{R.ARCHITECTURES[0]}/v/m/dev"
    text = "### Environment Interaction 1\r\n```\na ### Environment Interaction 2\n### Environment Interaction x\n```\n### Environment Interaction 2 \n```\n" + "b" * 50 + "\n```"
    rows = [(f"{at}/tasks/t_1/logs/environment_io.md", text), (f"{at}/tasks/t_2/logs/environment_io.md", ""), (f"{at}/evaluations/dev.json", '{"individual": {}}'), (f"{at}/evaluations/other.json", "broken"), (f"{at}/tasks/t_1/logs/notes.md", "x")]
    S.write_files(spark.createDataFrame(rows, "path string, text string"), f"file://{tmp_path}/r")
    for size in (5, 40, 1 << 20):
        files = S.read_files(spark, f"{tmp_path}/r", R.ARCHITECTURES, size)
        got = R.scan_interactions(files).collect()
        assert [(r.task_id, [(x.code, x.output) for x in r.interactions]) for r in got] == [("t_1", [("a ### Environment Interaction 2\n### Environment Interaction x", ""), ("b" * 50, "")])]
    assert R.source_rows(spark, f"{tmp_path}/r").count() == 1  # evaluated, though no task was
    assert S.read_files(spark, f"{tmp_path}/nowhere", R.ARCHITECTURES).count() == 0
