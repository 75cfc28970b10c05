"""Reading a nested release of trajectories into one table of traces.

Layout: ``<root>/<architecture>/<vendor>/<model>/<split>/`` with
``evaluations/<split>.json`` and ``tasks/<task>/{logs,dbs}/...``. One scan lists the tree and
reads byte ranges of all files as typed records; the kinds meet in joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import labels as L
from ..functions.text import scenario_of, strip, trace_id_of
from ..operators.sets import allow_list
from ..schemas import beside
from ..session import work_folder
from . import release_files

# Directory names, section marks and call shapes of a release.
ARCHITECTURES = ("legacy_full_code_agent", "legacy_function_calling_agent")
INFRASTRUCTURE_APPS = ("supervisor", "admin", "api_docs")
DEFAULT_DOMAIN = "supervisor"
FENCE = r"(?s)```(?:python)?\n(.*?)```"
COMPLETE_TASK = r"complete_task\(([^\n]*)"
STATUS = r"""(?U)['"]?status['"]?\s*[=:]\s*['"](\w+)['"]"""
API_CALL = r"apis\.([a-z_]+)\.([a-z_0-9]+)"
TASK_INSERT = r"INSERT INTO tasks \(([^)]*)\)"

KEYS = list(release_files.KEYS)
SPLIT_KEYS = KEYS[:4]


def scan(spark: SparkSession, root: str, architectures: Sequence[str]) -> DataFrame:
    """(kind, keys, place, text) of every record of a release, read once and kept apart by kind."""
    folder = work_folder(spark, "release")
    rows = release_files.read_files(spark, root, list(architectures))
    rows.write.partitionBy("kind").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def of_kind(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.col("kind") == kind).drop("kind")


def fenced(chunk: Column, i: int) -> Column:
    """The i-th fenced block of a section, trimmed; empty where there is none."""
    return F.coalesce(strip(F.try_element_at(F.regexp_extract_all(chunk, F.lit(FENCE), F.lit(1)), F.lit(i))), F.lit(""))


def sections(files: DataFrame) -> DataFrame:
    """(keys, place, code, output) of each section that holds either."""
    rows = of_kind(files, "interaction").withColumns({"code": fenced(F.col("text"), 1), "output": fenced(F.col("text"), 2)})
    return rows.drop("text").where((F.col("code") != "") | (F.col("output") != ""))


def scan_interactions(files: DataFrame) -> DataFrame:
    """(keys, interactions): the sections of a trajectory in order."""
    entry = F.array_sort(F.collect_list(F.struct("place", "code", "output")))
    rows = sections(files).groupBy(*KEYS).agg(entry.alias("s"))
    return rows.select(*KEYS, F.transform("s", lambda x: F.struct(x["code"].alias("code"), x["output"].alias("output"))).alias("interactions"))


def scan_api_calls(files: DataFrame) -> DataFrame:
    """One row per call; lines that are not JSON objects are dropped."""
    parsed = of_kind(files, "call").where(strip(F.col("text")) != "").withColumn("v", F.try_parse_json("text"))
    return parsed.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).select(
        *KEYS, F.coalesce(F.try_variant_get("v", "$.url", "string"), F.lit("")).alias("url")
    )


def goal_of_line(line: Column) -> Column:
    """The instruction value of an insert row, NULL on any other or malformed line."""
    v = F.try_parse_json(line)
    columns = F.transform(
        F.split(F.regexp_extract(F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.lit("")), TASK_INSERT, 1), ","), lambda c: strip(c)
    )
    place = F.array_position(columns, "instruction").cast("int")
    values = F.try_variant_get(v, "$[1]", "array<variant>")
    value = F.when(place > 0, F.try_element_at(values, F.nullif(place, F.lit(0))))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def scan_goals(files: DataFrame) -> DataFrame:
    """(keys, goal): the first insert line of a task that names an instruction."""
    found = of_kind(files, "goal").withColumn("goal", goal_of_line(F.col("text")))
    return found.where(F.col("goal").isNotNull()).groupBy(*KEYS).agg(F.min_by("goal", "place").alias("goal"))


TRUTH_SHAPE = "struct<success:boolean,difficulty:int,num_tests:int,failures:array<variant>>"


def ground_truth(files: DataFrame) -> DataFrame:
    """(keys, outcome) of each task of each split's own evaluation file."""
    rows = of_kind(files, "truth").where("task_id is not null").withColumn("t", F.from_json("text", TRUTH_SHAPE))
    return rows.select(
        *KEYS,
        F.col("t.success").alias("ground_truth_success"),
        "t.difficulty",
        F.coalesce("t.num_tests", F.lit(0)).alias("num_tests"),
        F.greatest(F.size(F.coalesce("t.failures", F.array().cast("array<variant>"))), F.lit(0)).alias("n_failed_tests"),
    )


def terminal_status(interactions: Column) -> Column:
    """The status word of the last completing call that names one."""
    words = F.flatten(
        F.transform(
            F.reverse(interactions),
            lambda x: F.reverse(
                F.transform(
                    F.regexp_extract_all(x["code"], F.lit(COMPLETE_TASK), F.lit(1)),
                    lambda call: F.regexp_extract(call, STATUS, 1),
                )
            ),
        )
    )
    return F.try_element_at(F.filter(words, lambda w: w != ""), F.lit(1))


def app_of_url(url: Column) -> Column:
    return F.try_element_at(F.filter(F.split(url, "/"), lambda p: p != ""), F.lit(1))


def most_called(calls: DataFrame, keys: Sequence[str], infrastructure: Sequence[str] = INFRASTRUCTURE_APPS) -> DataFrame:
    """Most-called app per key, the alphabetically first on a tie."""
    counts = (
        calls.where(F.col("app").isNotNull() & ~F.col("app").isin(*infrastructure))
        .groupBy(*keys, "app")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy(*keys).agg(F.min_by("app", F.struct(-F.col("n"), F.col("app"))).alias("app"))


def code_calls(interactions: Column, group: int) -> Column:
    return F.flatten(
        F.transform(interactions, lambda x: F.regexp_extract_all(x["code"], F.lit(API_CALL), F.lit(group)))
    )


def touched_tools(interactions: Column) -> Column:
    """Sorted distinct ``app.function`` names seen in the code."""
    names = F.zip_with(code_calls(interactions, 1), code_calls(interactions, 2), lambda a, f: F.concat_ws(".", a, f))
    return F.array_sort(F.array_distinct(names))


def build_events(interactions: Column) -> Column:
    """A call and a result per interaction, then the last code again as the closing message."""
    none = F.lit(None).cast("string")

    def event(seq: Column, kind: str, tool: Column, arguments: Column, status: Column, data: Column, text: Column) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"), F.lit(kind).alias("type"), tool.alias("tool"), arguments.alias("arguments"),
            status.alias("status"), data.alias("data"), text.alias("text"),
        )

    python = F.lit("execute_python")
    pairs = F.transform(
        interactions,
        lambda x, i: F.array(
            event(i * 2, "assistant_tool_call", python, F.to_json(F.struct(x["code"].alias("code"))), none, none, none),
            event(i * 2 + 1, "tool_result", python, none, F.lit("returned"), F.to_json(F.struct(x["output"].alias("output"))), none),
        ),
    )
    last = F.coalesce(F.try_element_at(interactions, F.lit(-1))["code"], F.lit(""))
    closing = event(F.size(interactions) * 2, "assistant_message", none, none, none, none, last)
    return F.concat(F.flatten(pairs), F.array(closing))


def present_architectures(spark: SparkSession, root: str, architectures: Sequence[str]) -> list[str]:
    """Folders of the release that are on the list; the others are named when none is."""
    found = spark.createDataFrame([(n,) for n in release_files.children(root)], "architecture string")
    return sorted(r[0] for r in allow_list(found, "architecture", architectures).select("architecture").collect())


def source_rows(spark: SparkSession, root: str, architectures: Sequence[str] = ARCHITECTURES) -> DataFrame:
    """One row per trajectory that has interactions and whose split was evaluated."""
    return assembled(scan(spark, root, present_architectures(spark, root, architectures)))


def assembled(files: DataFrame) -> DataFrame:
    """The kinds of a scan joined per trajectory; what is missing stays null or zero."""
    inter, evaluated = scan_interactions(files), of_kind(files, "truth").select(*SPLIT_KEYS).distinct()
    calls = scan_api_calls(files).withColumn("app", app_of_url(F.col("url")))
    from_code = inter.select(*KEYS, F.explode(code_calls(F.col("interactions"), 1)).alias("app"))
    n_calls = calls.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_api_calls"))
    return (
        inter.join(evaluated, SPLIT_KEYS, "left_semi")
        .join(ground_truth(files), KEYS, "left")
        .join(scan_goals(files), KEYS, "left")
        .join(most_called(calls, KEYS).withColumnRenamed("app", "url_app"), KEYS, "left")
        .join(most_called(from_code, KEYS).withColumnRenamed("app", "code_app"), KEYS, "left")
        .join(n_calls, KEYS, "left")
        .withColumns(
            {
                "goal": F.coalesce("goal", F.lit("")),
                "raw_status": terminal_status(F.col("interactions")),
                "scenario_id": scenario_of(F.col("task_id")),
                "domain": F.coalesce("url_app", "code_app", F.lit(DEFAULT_DOMAIN)),
                "num_tests": F.coalesce("num_tests", F.lit(0)),
                "n_failed_tests": F.coalesce("n_failed_tests", F.lit(0)),
                "n_api_calls": F.coalesce("n_api_calls", F.lit(0)),
            }
        )
        .withColumn("claim", L.normalise_claim(F.col("raw_status")))
        .withColumn("drop_reason", L.drop_reason(F.col("goal"), F.col("claim"), F.col("ground_truth_success")))
    )


def to_traces(rows: DataFrame, corpus: str) -> DataFrame:
    """Kept source rows as traces; the audit fields go to ``oracle``, out of any input view."""
    kept = rows.where(F.col("drop_reason").isNull())
    label = L.label_for(F.col("claim"), F.col("ground_truth_success"))
    oracle = F.struct(
        F.lit(corpus).alias("source"), "architecture", "model_family", "benchmark_split", "task_id", "raw_status",
        F.col("claim").alias("normalised_claim"), "ground_truth_success", "difficulty", "num_tests", "n_failed_tests",
        F.size("interactions").alias("n_interactions"), "n_api_calls",
    )
    return kept.withColumn("label", label).select(
        trace_id_of(corpus, *[F.col(c) for c in ("architecture", "model_family", "benchmark_split", "task_id")]).alias("trace_id"),
        "domain",
        F.col("scenario_id").alias("template_family"),
        "goal",
        F.transform(
            touched_tools(F.col("interactions")),
            lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("required")),
        ).alias("tool_schema"),
        build_events(F.col("interactions")).alias("events"),
        "label",
        L.fault_for(F.col("label"), F.col("difficulty")).alias("fault_type"),
        F.to_json(oracle).alias("oracle"),
    )


def ingest(spark: SparkSession, root: str, corpus: str, licences: DataFrame, architectures: Sequence[str] = ARCHITECTURES) -> tuple[DataFrame, DataFrame]:
    """(traces, one-row counts). The licence is checked before anything is read."""
    licence_gate(licences, corpus)
    rows = source_rows(spark, root, architectures)
    L.refuse_unknown_claims(rows)
    return to_traces(rows, corpus), L.ingest_counts(rows)


def licence_gate(licences: DataFrame, corpus: str) -> None:
    from ..schemas import IntegrityError

    row = licences.where(F.col("corpus") == corpus).select("permits_this_use").limit(1).collect()
    if not row or not row[0][0]:
        raise IntegrityError(f"no recorded licence permits reading {corpus!r}")


def licence_violations(requested: DataFrame, licences: DataFrame) -> DataFrame:
    """Requested corpora without a permitting licence row."""
    allowed = licences.where("permits_this_use").select("corpus")
    return requested.join(allowed, "corpus", "left_anti")


def provenance_row(traces: DataFrame, counts: DataFrame, splits: DataFrame, corpus: str, kind: str) -> DataFrame:
    """One row that says where a data set came from and what was kept."""
    label = traces.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    fault = traces.groupBy("fault_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fault_type", "n")))).alias("fault_counts"))
    sizes = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("split_sizes"))
    return beside(label, fault, sizes, counts).select(
        F.lit(corpus).alias("dataset_id"), F.lit(kind).alias("kind"), "*"
    )
