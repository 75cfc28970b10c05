"""Reading and writing traces, runs, accounts and audit sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X
from ..operators.joins import price_join
from ..operators.operational import with_cost
from ..schemas import DEVIATION, EVENT, PREDICTION, TRACE, TRUNCATION, IntegrityError, refuse_if_any
from ..session import forget

# Audit sheet columns.
KEY_COLUMNS = ("trace_id", "domain", "template_family", "label", "fault_type", "audit_stratum", "in_sample")
AUDITOR_COLUMNS = ("auditor_id", "auditor_label", "auditor_fault_type", "auditor_note")


def unknown_fields(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """(field) names outside the closed schema, at the top level and in events."""
    parsed = lines.select(F.from_json("value", "map<string,variant>").alias("m"))
    events = F.try_variant_get(F.try_element_at("m", F.lit("events")), "$", "array<map<string,variant>>")
    top = F.array_except(F.map_keys("m"), F.array(*[F.lit(n) for n in schema.names]))
    inner = F.array_except(
        F.flatten(F.transform(events, lambda e: F.map_keys(e))), F.array(*[F.lit(n) for n in EVENT.names])
    )
    none = F.array().cast("array<string>")
    return parsed.select(F.explode(F.array_distinct(F.concat(F.coalesce(top, none), F.coalesce(inner, none)))).alias("field"))


def read_traces(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """JSON lines under the closed trace schema; blank lines skipped, bad rows raise."""
    if check:
        lines = spark.read.text(path).where(X.strip(F.col("value")) != "")
        refuse_if_any(unknown_fields(lines, TRACE).distinct(), "fields outside the trace schema")
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def canonical_trace_line(traces: DataFrame) -> DataFrame:
    """One canonical JSON text per trace, its free JSON fields nested rather than quoted."""
    event = lambda e: e.withField("arguments", F.parse_json(e["arguments"])).withField("data", F.parse_json(e["data"]))
    nested = traces.withColumns({"events": F.transform("events", event), "oracle": F.parse_json("oracle")})
    whole = F.to_json(F.struct(*[F.col(n) for n in TRACE.names]), {"ignoreNullFields": "false"})
    return nested.select(X.canonical_json(whole).alias("value"))


def write_traces(traces: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """The native form: Parquet, partitioned where a query prunes."""
    traces.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def export_traces(traces: DataFrame, path: str) -> None:
    canonical_trace_line(traces).write.mode("errorifexists").text(path)


# -- runs -----------------------------------------------------------------------------


def read_runs(spark: SparkSession, root: str, manifest: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(manifests, predictions) of every run folder one level under ``root``."""
    run_dir = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    manifests = spark.read.schema(manifest).option("multiLine", "true").json(f"{root}/*/manifest.json")
    predictions = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(f"{root}/*/predictions.jsonl")
    return manifests.withColumn("run_dir", run_dir), predictions.withColumn("run_dir", run_dir)


def by_run(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("run_id", "trace_id").sortWithinPartitions("run_id", "trace_id")


def redacted(rows: DataFrame, secrets: DataFrame) -> DataFrame:
    return X.redact_columns(X.with_secrets(rows, secrets), F.col("secrets"))


LEAK = "a live secret survives redaction"


def leaks(rows: DataFrame) -> Column:
    """Whether the JSON text of a redacted row holds one of its ``secrets``."""
    return X.contains_secret(F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "secrets"])), F.col("secrets"))


def write_run(predictions: DataFrame, prices: DataFrame, secrets: DataFrame, path: str) -> None:
    """Price, redact, refuse a surviving secret, then write rows and attempts once.

    A folder that already exists is refused; nothing is ever overwritten. Rows of a run
    stand together, in ranges of (run, trace): files follow the size of the table, not the
    number of runs, and a reader of one run skips the other ranges by their bounds.

    Secrets are looked for before rows are priced, which moves none of them, and again with the cost where rows
    are written; a secret without a comma cannot reach over two columns. Attempts need no price.
    """
    spark = predictions.sparkSession
    priced = with_cost(price_join(predictions, prices))
    apart = secrets.where(F.exists("secrets", lambda s: F.contains(s, F.lit(",")))).isEmpty()
    clean = redacted(predictions if apart else priced, secrets)
    refuse_if_any(clean.where(leaks(clean)).select("trace_id"), LEAK)
    # Rows are dealt before they are redacted: the deal looks at all rows twice.
    rows = redacted(by_run(priced.drop("attempts")), secrets)
    if apart:
        refused = F.raise_error(F.concat(F.lit(f"{LEAK}: "), F.coalesce("trace_id", F.lit("")))).cast("string")
        rows = rows.withColumn("trace_id", F.when(leaks(rows), refused).otherwise(F.col("trace_id")))
    try:
        rows.drop("secrets").write.mode("errorifexists").parquet(f"{path}/predictions")
    except Exception as failed:
        if LEAK not in str(failed):
            raise
        forget(spark, f"{path}/predictions")
        raise IntegrityError(LEAK) from None
    single = prices.where("model_id IS NOT NULL").groupBy("model_id").count().where("count > 1").isEmpty()
    attempts = redacted(by_run((predictions if single else priced).select("run_id", "trace_id", "attempts")), secrets)
    attempts.select("run_id", "trace_id", F.explode("attempts").alias("a")).select("run_id", "trace_id", "a.*").write.mode("errorifexists").parquet(f"{path}/attempts")


def write_accounts(truncations: DataFrame, deviations: DataFrame, path: str) -> None:
    """Both accounts with their schemas, written even when they hold no row."""
    spark = truncations.sparkSession
    for rows, schema, order, name in (
        (truncations, TRUNCATION, "trace_id", "truncations"),
        (deviations, DEVIATION, "parameter", "deviations"),
    ):
        shaped = spark.createDataFrame([], schema).unionByName(rows.select(*[f.name for f in schema]))
        shaped.orderBy(order).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_account(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The account's rows, or None where none was ever written (unknown, not empty)."""
    schema = {"truncations": TRUNCATION, "deviations": DEVIATION}[name]
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def load_provenance(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The provenance row, or an empty table where the document is missing or unreadable."""
    from .dims import whole_files

    try:
        # text that is no JSON reads as a row of nulls, so it is left out first
        rows = whole_files(spark, path).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("d")).where("d IS NOT NULL").select("d.*")
        rows.schema  # noqa: B018
        return rows
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schema.removeprefix("struct<").removesuffix(">").replace(":", " "))
        raise


# -- audit sheets ---------------------------------------------------------------------


def audit_key(traces: DataFrame, sample: DataFrame) -> DataFrame:
    marked = traces.join(sample.select("trace_id", F.lit("TRUE").alias("in_sample")), "trace_id", "left")
    return marked.select(
        "trace_id", "domain", "template_family", "label", "fault_type",
        F.concat_ws("/", "label", "fault_type").alias("audit_stratum"), F.coalesce("in_sample", F.lit("FALSE")).alias("in_sample"),
    )


def blind_sheet(traces: DataFrame, sample: DataFrame) -> DataFrame:
    """What an auditor fills in: no label, no fault, empty answer columns."""
    marked = traces.join(sample.select("trace_id", F.lit("TRUE").alias("in_sample")), "trace_id", "left")
    return marked.select(
        "trace_id",
        F.coalesce("in_sample", F.lit("FALSE")).alias("in_sample"),
        X.render_trace(F.col("goal"), F.col("events")).alias("rendered_trace"),
        *[F.lit("").alias(c) for c in AUDITOR_COLUMNS],
    )


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", "true").option("emptyValue", "").option("escape", '"').csv(path)


def clean_sheet(rows: DataFrame) -> DataFrame:
    """Trimmed auditor cells and an upper-cased sample mark."""
    shape = {c: X.strip(F.coalesce(F.col(c), F.lit(""))) for c in AUDITOR_COLUMNS if c in rows.columns}
    if "in_sample" in rows.columns:
        shape["in_sample"] = F.upper(X.strip(F.coalesce("in_sample", F.lit(""))))
    return rows.withColumns(shape)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return clean_sheet(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path))


# -- exports and listings -----------------------------------------------------------------


def export_view(rows: DataFrame | Sequence[DataFrame], path: str) -> None:
    """CSV with the union of all columns as header."""
    parts = [rows] if isinstance(rows, DataFrame) else list(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out.write.mode("errorifexists").option("header", "true").csv(path)


def list_datasets(provenance: DataFrame) -> DataFrame:
    """Real corpora first, then generated sets, each by id; only sets that exist."""
    present: Column = F.col("exists")
    return provenance.where(present).orderBy(F.col("kind") != "real", "dataset_id").drop("exists")


def require_columns(rows: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise IntegrityError(f"missing columns {missing}")
