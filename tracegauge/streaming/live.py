"""Live views of a run while its predictions are still being written.

The writer drops whole files into a folder (write, then rename); a file is read once
and never grows. Every aggregate here is a sum, so state is one row per group and a
micro-batch only folds what is new.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip
from ..operators.joins import public_rows
from ..schemas import POSITIVE_LABEL, PREDICTION, ratio
from ..session import work_folder

CORRUPT = "_corrupt_record"
ERROR_BUDGET, ERROR_MIN_SAMPLES = 0.05, 20


def tail_predictions(
    spark: SparkSession, folder: str, schema: T.StructType = PREDICTION, files_per_trigger: int | None = None
) -> DataFrame:
    """New prediction lines as a stream; lines that do not parse keep their text."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = reader.text(folder).where(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", wide, options).alias("r")).select("r.*")


def good_rows(stream: DataFrame) -> DataFrame:
    return stream.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_rows(stream: DataFrame) -> DataFrame:
    """What could not be read, for a side table; nothing is dropped."""
    return stream.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def replay(spark: SparkSession, folder: str, schema: T.StructType = PREDICTION, files_per_trigger: int = 1, parts: bool = False) -> DataFrame:
    """A finished run file by file, in order of writing, then name; pace it with the trigger's processing time.

    With ``parts``, a file is a folder of parts that its writers wrote side by side.
    The file source orders by modification time alone, so the run is first laid out again
    as one folder per place in that order, with times a second apart (a store that keeps
    modification times, such as a local disk or HDFS, is needed for that). Each task writes
    what it scans, so a file may become several; empty ones make up their number
    to the same at every place, and a trigger takes whole places.
    """
    path, meta = spark._jvm.org.apache.hadoop.fs.Path, F.col("_metadata")
    name = F.regexp_replace(meta["file_path"], "/[^/]*$", "") if parts else meta["file_path"]
    listed = spark.read.format("binaryFile").load(folder).where("length > 0").select(name.alias("file"), "modificationTime")  # no content is read
    files = listed.groupBy("file").agg(F.max("modificationTime").alias("written"))  # a row per file
    placed = files.withColumn("place", F.row_number().over(W.orderBy("written", "file"))).select("file", "place")
    lines = spark.read.text(folder).select("value", name.alias("file"))
    stage = work_folder(spark, "replay")
    lines.join(F.broadcast(placed), "file").select("value", "place").write.partitionBy("place").text(stage)
    store = path(stage).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    written = [status.getPath() for status in store.globStatus(path(f"{stage}/place=*/part-*")) or []]
    homes = Counter(own.getParent().toString() for own in written)
    most = max(homes.values(), default=1)
    for home, n in homes.items():
        for k in range(n, most):
            written.append(path(f"{home}/part-none-{k}.txt"))
            store.create(written[-1]).close()
    for own in written:
        store.setTimes(own, 1000 * int(own.getParent().getName().split("=")[1]), -1)
    return tail_predictions(spark, stage, schema, files_per_trigger * most)


def live_rows(stream: DataFrame, truth: DataFrame, threshold: Column) -> DataFrame:
    """Each new prediction as a public row: a stream-static join, append mode."""
    return public_rows(stream, truth, threshold)


def snapshot_counts(rows: DataFrame, keys: Sequence[str] = ("provider", "label", "fault_type")) -> DataFrame:
    """Additive counts per group; the same expression over a stream or a table.

    ``rows`` are predictions joined to truth, with ``threshold`` and ``n_attempts``.
    """
    point = F.col("repeat_no") == 0
    scored = point & F.col("primary_score").isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("predictions"),
        n(scored).alias("scored"),
        n(scored & (F.col("primary_score") >= F.col("threshold"))).alias("flagged"),
        F.count("error").alias("errors"),
        n(F.contains(F.col("error"), F.lit("ParseFailure"))).alias("parse_failures"),
        F.sum(F.greatest(F.col("n_attempts") - 1, F.lit(0))).cast("bigint").alias("retries"),
        F.sum("input_tokens").alias("input_tokens"),
    )


def snapshot(counts: DataFrame) -> DataFrame:
    """Confusion counts and rates per provider from the snapshot counts."""
    pos = F.col("label") == POSITIVE_LABEL
    part = lambda cond, what: F.sum(F.when(cond, what).otherwise(0))
    flagged, kept = F.col("flagged"), F.col("scored") - F.col("flagged")
    out = counts.groupBy("provider").agg(
        F.sum("predictions").alias("predictions"),
        part(pos, flagged).alias("tp"),
        part(~pos, flagged).alias("fp"),
        part(pos, kept).alias("fn"),
        part(~pos, kept).alias("tn"),
        F.sum("errors").alias("errors"),
    )
    return out.withColumns(
        {
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "error_rate": ratio(F.col("errors"), F.col("predictions")),
        }
    )


def repeat_state(stream: DataFrame, keys: Sequence[str] = ("provider",), arrival: str = "arrival") -> DataFrame:
    """Per (keys, trace) the last repeat 0 and the first arrival, both kept in state.

    A repeat that lands before repeat 0 stands in for it until it comes.
    """
    rest = [c for c in stream.columns if c not in (*keys, "trace_id")]
    zero = F.col("repeat_no") == 0
    row = F.struct(*rest)
    return stream.groupBy(*keys, "trace_id").agg(
        F.max_by(row, F.when(zero, F.col(arrival))).alias("zero"), F.min_by(row, F.col(arrival)).alias("first")
    )


def choose_points(state: DataFrame, keys: Sequence[str] = ("provider",)) -> DataFrame:
    """Point predictions from repeat state, with the arm-wide rule of the batch operator."""
    arms = state.groupBy(*keys).agg(F.bool_or(F.col("zero").isNotNull()).alias("has_zero"))
    row = F.when(F.col("has_zero"), F.col("zero")).otherwise(F.col("first"))
    return state.join(arms, list(keys)).withColumn("row", row).where("row IS NOT NULL").select(*keys, "trace_id", "row.*")


def error_counts(stream: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("error").alias("failed"))


def over_error_budget(counts: DataFrame, max_rate: float = ERROR_BUDGET, min_samples: int = ERROR_MIN_SAMPLES) -> DataFrame:
    """Arms whose running error rate is over budget at the end of a micro-batch."""
    return counts.where((F.col("total") >= min_samples) & (ratio(F.col("failed"), F.col("total")) > max_rate))


def run_status(runs: DataFrame, predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Written against expected per run; finished when complete and drained."""
    written = predictions.groupBy("run_id").agg(F.count(F.lit(1)).alias("written"))
    joined = runs.select("run_id", "status").join(written, "run_id", "left").join(expected, "run_id", "left")
    joined = joined.withColumn("written", F.coalesce("written", F.lit(0)))
    return joined.withColumn("finished", (F.col("status") == "complete") & (F.col("written") >= F.coalesce("expected", F.lit(0))))


# -- running ------------------------------------------------------------------------------


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available into files, and read them back."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_state(stream: DataFrame, folder: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the newest full state of an aggregate in ``folder/batch=<n>`` files.

    ``on_batch`` is the per-batch hook: alerts, deferred statistics, a push of new rows.
    """

    def save(batch: DataFrame, number: int) -> None:
        target = f"{folder}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        if on_batch is not None:  # the hook reads what was written: the batch is evaluated once
            on_batch(batch.sparkSession.read.schema(batch.schema).parquet(target), number)

    return (
        stream.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def drain_state(stream: DataFrame, name: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run an aggregate over everything available and read its last state."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    write_state(stream, folder, on_batch).awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def drain_updates(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run an aggregate whose state has a row per trace: only changed rows are written.

    Reading back keeps each key's row from the last batch that changed it.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")
