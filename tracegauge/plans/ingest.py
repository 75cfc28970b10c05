"""Queries over a release of trajectories written out from the conversations.

Sixteen turns of a conversation are one task: user and assistant turns are the code and the output of
its sections, and its completion status, goal, calls and verdict follow from ids and turns. The
tree is written as files, scanned back through the release source, and compared with the same facts
taken straight from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels as L
from ..session import work_folder
from ..sources import release as R, release_files, traces as TR
from . import corpus
from .registry import query

CORPUS = "release"
_KEYS = "architecture, vendor, model_family, benchmark_split, task_id"

# Turns with their task; a repeated turn counts once. Read by both engines.
_TURNS = """SELECT conv_id, turn, max(text) AS text, CAST(floor(turn / 16) AS BIGINT) AS part, CAST(floor(turn % 16 / 2) AS BIGINT) AS place, turn % 2 AS side
FROM {conversations} WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn"""
_TASK = """CASE WHEN conv_id % 2 = 0 THEN 'legacy_full_code_agent' ELSE 'legacy_function_calling_agent' END AS architecture,
concat('v', CAST(conv_id % 3 AS STRING)) AS vendor, concat('m', CAST(CAST(floor(conv_id / 500) AS BIGINT) AS STRING)) AS model_family, CASE WHEN conv_id % 4 = 0 THEN 'dev' ELSE 'test_normal' END AS benchmark_split,
concat('c', CAST(conv_id AS STRING), '_', CAST(part AS STRING)) AS task_id"""
_STATUS = "CASE (conv_id + part) % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'fail' WHEN 2 THEN 'Completed' WHEN 3 THEN 'success' END"
_SECTIONS = """SELECT conv_id, part, place, coalesce(max(CASE WHEN side = 0 THEN trim(text) END), '') AS code, coalesce(max(CASE WHEN side = 1 THEN trim(text) END), '') AS output FROM turns GROUP BY conv_id, part, place"""
_TASKS = f"""SELECT conv_id, part, {_TASK}, count(*) AS n_turns, {_STATUS} AS raw_status, CASE WHEN conv_id % 11 <> 0 THEN min(concat('goal of ', CAST(turn AS STRING), ' ünder "quotes"')) END AS goal,
conv_id % 7 <> 0 AS judged, (conv_id + part) % 2 = 0 AS success, 1 + conv_id % 4 AS difficulty, part % 3 AS n_failed FROM turns GROUP BY conv_id, part"""
VIEWS = {"turns": _TURNS, "sections": _SECTIONS, "tasks": _TASKS}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    base = corpus.base(spark, sf, "conversations")
    turns = spark.sql(_TURNS, conversations=base)
    return turns if name == "turns" else spark.sql(VIEWS[name].replace("FROM turns", "FROM {turns}"), turns=turns)


def fence(text, language: str = ""):
    return F.concat(F.lit(f"```{language}\n"), text, F.lit("\n```\n"))


def release_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text) of every file of the release; the turns of a task and the tasks of a model family have a bound."""
    tasks, sections = view(spark, sf, "tasks"), view(spark, sf, "sections")
    folder = F.concat_ws("/", "architecture", "vendor", "model_family", "benchmark_split")
    own = F.concat_ws("/", folder, F.lit("tasks"), "task_id")
    section = F.concat(F.lit("\n### Environment Interaction "), F.col("place") + 1, F.lit("  \n\n"), fence(F.col("code"), "python"), F.lit("\n"), fence(F.col("output")))
    logs = sections.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", section.alias("s")))).alias("s"))
    last = F.when(F.col("raw_status").isNotNull(), F.concat(F.lit("\napis.supervisor.complete_task(status='"), F.col("raw_status"), F.lit("')"))).otherwise("")
    code = F.concat(F.lit("apis.mail.send()\napis.app"), F.col("conv_id") % 3, F.lit(".run(1)"), last)
    text = F.concat(F.lit("preamble ``` of no section\n"), F.array_join(F.transform("s", lambda x: x["s"]), ""), F.lit("\n### Environment Interaction 99\n\n"), fence(code, "python"))
    made = [tasks.join(logs, ["conv_id", "part"]).select(F.concat(own, F.lit("/logs/environment_io.md")).alias("path"), text.alias("text"))]
    line = F.to_json(F.struct(F.concat(F.lit("/app"), F.col("turn") % 3, F.lit("/x")).alias("url")))
    urls = view(spark, sf, "turns").groupBy("conv_id", "part").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    made.append(tasks.join(urls, ["conv_id", "part"]).select(F.concat(own, F.lit("/logs/api_calls.jsonl")).alias("path"), F.concat("lines", F.lit('\n\nnot json\n[1]\n{"url": "/supervisor/y"}')).alias("text")))
    insert = F.concat(F.lit('["INSERT INTO tasks (id, instruction) VALUES (?, ?)", [1, '), F.regexp_extract(F.to_json(F.array("goal")), r"(?s)^\[(.*)\]$", 1), F.lit("]]"))
    goals = F.concat(F.lit('broken INSERT INTO tasks\n["INSERT INTO other (a)", [1]]\n'), F.coalesce(insert, F.lit("")), F.lit("\n"))
    made.append(tasks.select(F.concat(own, F.lit("/dbs/supervisor.jsonl")).alias("path"), goals.alias("text")))
    record = F.struct("success", F.when(F.col("difficulty") < 4, F.col("difficulty")).alias("difficulty"), F.col("n_turns").alias("num_tests"), F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.col("n_failed").cast("int")).alias("failures"))
    entry = F.struct("task_id", record.alias("r"))
    docs = tasks.where("judged").groupBy("architecture", "vendor", "model_family", "benchmark_split").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("individual"))
    path = F.concat(folder, F.lit("/evaluations/"), "benchmark_split", F.lit(".json"))
    made.append(docs.select(path.alias("path"), F.to_json(F.struct("individual")).alias("text")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def release(spark: SparkSession, sf: str) -> DataFrame:
    """A scan of the release written anew to the shared folder."""
    root = work_folder(spark, "release-files")
    release_files.write_files(release_rows(spark, sf), root)
    return R.scan(spark, root, R.present_architectures(spark, root, R.ARCHITECTURES))


def check(body: str) -> str:
    """Check SQL over the same turns, sections and tasks."""
    parts = ", ".join(f"{name} AS ({sql.format(conversations='conversations')})" for name, sql in VIEWS.items())
    return f"WITH {parts} {body}"


@query("s6_scan_interactions", check(f"""SELECT {_KEYS}, place, md5(code) AS code, md5(output) AS output FROM sections JOIN tasks USING (conv_id, part) WHERE code <> '' OR output <> ''
UNION ALL SELECT {_KEYS}, 98, md5(concat('apis.mail.send()' || chr(10) || 'apis.app', CAST(conv_id % 3 AS STRING), '.run(1)', CASE WHEN raw_status IS NOT NULL THEN concat(chr(10), 'apis.supervisor.complete_task(status=''', raw_status, ''')') ELSE '' END)), md5('') FROM tasks"""))
def interactions(spark, sf):
    rows = R.scan_interactions(release(spark, sf))
    # sections without code and output are gone, so places are counted by what a section holds
    each = rows.select(*R.KEYS, F.posexplode("interactions").alias("i", "s"), F.size("interactions").alias("n"))
    known = view(spark, sf, "sections").where("code <> '' OR output <> ''").join(view(spark, sf, "tasks"), ["conv_id", "part"])
    order = known.groupBy(*R.KEYS).agg(F.array_sort(F.collect_list("place")).alias("places"))
    place = F.when(F.col("i") == F.col("n") - 1, F.lit(98)).otherwise(F.try_element_at("places", F.col("i") + 1))
    return each.join(order, R.KEYS, "left").select(*R.KEYS, place.cast("bigint").alias("place"), F.md5("s.code").alias("code"), F.md5("s.output").alias("output"))


@query("s7_scan_api_calls", check(f"""SELECT {_KEYS}, url, count(*) AS n FROM (SELECT conv_id, part, concat('/app', CAST(turn % 3 AS STRING), '/x') AS url FROM turns UNION ALL SELECT conv_id, part, '/supervisor/y' FROM tasks) u JOIN tasks USING (conv_id, part) GROUP BY ALL"""))
def api_calls(spark, sf):
    return R.scan_api_calls(release(spark, sf)).groupBy(*R.KEYS, "url").agg(F.count(F.lit(1)).alias("n"))


@query("s5_scan_goals", check(f"SELECT {_KEYS}, goal FROM tasks WHERE goal IS NOT NULL"))
def goals(spark, sf):
    return R.scan_goals(release(spark, sf))


@query("s4_scan_ground_truth", check(f"SELECT {_KEYS}, success AS ground_truth_success, CASE WHEN difficulty < 4 THEN difficulty END AS difficulty, n_turns AS num_tests, n_failed AS n_failed_tests FROM tasks WHERE judged"))
def truth(spark, sf):
    return R.ground_truth(release(spark, sf))


_ROWS = f""", splits AS (SELECT DISTINCT architecture, vendor, model_family, benchmark_split FROM tasks WHERE judged),
apps AS (SELECT conv_id, part, app FROM (SELECT conv_id, part, concat('app', CAST(turn % 3 AS STRING)) AS app, row_number() OVER (PARTITION BY conv_id, part ORDER BY count(*) DESC, concat('app', CAST(turn % 3 AS STRING))) AS k FROM turns GROUP BY conv_id, part, turn % 3) q WHERE k = 1),
filled AS (SELECT conv_id, part, count(*) AS n FROM sections WHERE code <> '' OR output <> '' GROUP BY conv_id, part),
rows_ AS (SELECT t.*, app AS domain, coalesce(f.n, 0) + 1 AS n_interactions, n_turns + 1 AS n_api_calls, CASE WHEN raw_status = 'fail' THEN 'failure' WHEN raw_status IS NOT NULL THEN 'success' END AS claim,
CASE WHEN judged THEN success END AS gt, CASE WHEN judged AND difficulty < 4 THEN difficulty END AS hard, CASE WHEN judged THEN n_turns ELSE 0 END AS tests, CASE WHEN judged THEN n_failed ELSE 0 END AS failed
FROM tasks t JOIN splits USING (architecture, vendor, model_family, benchmark_split) JOIN apps USING (conv_id, part) LEFT JOIN filled f USING (conv_id, part)),
kept AS (SELECT *, CASE WHEN goal IS NULL THEN 'no_goal' WHEN claim = 'success' AND gt IS NULL THEN 'no_ground_truth' END AS drop_reason FROM rows_)"""


@query("s3_j5_scan_release", check("SELECT 1").replace(" SELECT 1", _ROWS) + f""" SELECT {_KEYS}, concat('c', CAST(conv_id AS STRING)) AS scenario_id, domain, coalesce(goal, '') AS goal, raw_status, claim, n_interactions, n_api_calls, gt AS ground_truth_success, hard AS difficulty, tests AS num_tests, failed AS n_failed_tests, drop_reason FROM kept""")
def source_rows(spark, sf):
    rows = R.assembled(release(spark, sf))
    return rows.select(*R.KEYS, "scenario_id", "domain", "goal", "raw_status", "claim", F.size("interactions").alias("n_interactions"), "n_api_calls", "ground_truth_success", "difficulty", "num_tests", "n_failed_tests", "drop_reason")


@query("f40_f41_p7_to_traces", check("SELECT 1").replace(" SELECT 1", _ROWS) + f""" SELECT concat('{CORPUS}/', architecture, '/', model_family, '/', benchmark_split, '/', task_id) AS trace_id, domain, concat('c', CAST(conv_id AS STRING)) AS template_family, goal, 2 * n_interactions + 1 AS n_events,
CASE WHEN raw_status IS NULL THEN 0 ELSE 1 END + 1 AS n_tools, CASE WHEN claim IS NULL THEN 'no_success_claim' WHEN claim = 'failure' THEN 'reported_failure_or_uncertainty' WHEN gt THEN 'supported_success' ELSE 'unsupported_success' END AS label,
CASE WHEN claim IS NULL THEN 'real_no_completion_claim' WHEN claim = 'failure' THEN 'real_reported_failure' WHEN gt THEN 'real_supported_completion' WHEN hard = 1 THEN 'real_unsupported_completion_easy' WHEN hard = 3 THEN 'real_unsupported_completion_hard' ELSE 'real_unsupported_completion_medium' END AS fault_type,
CAST(failed AS BIGINT) AS oracle_failed, md5(concat('apis.mail.send()' || chr(10) || 'apis.app', CAST(conv_id % 3 AS STRING), '.run(1)', CASE WHEN raw_status IS NOT NULL THEN concat(chr(10), 'apis.supervisor.complete_task(status=''', raw_status, ''')') ELSE '' END)) AS closing FROM kept WHERE drop_reason IS NULL""")
def traces(spark, sf):
    rows = R.to_traces(R.assembled(release(spark, sf)), CORPUS)
    last = F.element_at("events", -1)
    return rows.select(
        "trace_id", "domain", "template_family", "goal", F.size("events").alias("n_events"), F.size("tool_schema").alias("n_tools"), "label", "fault_type",
        F.get_json_object("oracle", "$.n_failed_tests").cast("bigint").alias("oracle_failed"), F.md5(last["text"]).alias("closing"),
    )


@query("p7_ingest_counts", check("SELECT 1").replace(" SELECT 1", _ROWS) + " SELECT count(*) AS seen, count(*) FILTER (WHERE drop_reason IS NULL) AS kept, count(*) FILTER (WHERE drop_reason = 'no_goal') AS dropped_no_goal, count(*) FILTER (WHERE drop_reason = 'no_ground_truth') AS dropped_no_ground_truth FROM kept")
def counts(spark, sf):
    return L.ingest_counts(R.assembled(release(spark, sf)))


@query("s14_load_provenance", "SELECT source AS dataset_id, count(*) AS seen, count(*) FILTER (WHERE n_chars > 1000) AS kept FROM documents WHERE source IS NOT NULL GROUP BY source")
def provenance(spark, sf):
    """A provenance document per source, one that cannot be read, and a folder that is not there."""
    rows = corpus.base(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("dataset_id")).agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("n_chars") > 1000, 1)).alias("kept"))
    docs = rows.select(F.concat("dataset_id", F.lit(".json")).alias("path"), F.to_json(F.struct("*")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([("broken.json", '{"dataset_id": "broken", "seen": ')], "path string, text string"))
    root = work_folder(spark, "provenance")
    release_files.write_files(docs, root)
    schema = "struct<dataset_id:string,seen:bigint,kept:bigint>"
    return TR.load_provenance(spark, root, schema).unionByName(TR.load_provenance(spark, f"{root}-missing", schema))
