"""Session helpers shared by the benchmark and the tests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SPREAD_BYTES = 64 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tracegauge") -> SparkSession:
    """A local session with the settings the library expects on a cluster too."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACEGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one only where all tasks run in this very process."""
    configured = spark.conf.get(CHECKPOINT_KEY, "")
    if configured:
        path = configured
    elif spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    else:
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores if the optimizer knows them to be at most ``SPREAD_BYTES``.

    A small input in one file would otherwise run its per-row work in one task. Anything
    larger is left as it is scanned, whatever the number of partitions or cores.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else rows


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key``, so what is made of a row can be grouped by the key without moving again.

    The number of partitions is left to the session and to adaptive execution: estimates of joins and of
    rows without statistics are far too high to choose it by.
    """
    return rows.repartition(key)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled_folder(rows: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """As ``settle``, with the folder, for a caller that knows when the table is done with."""
    spark = rows.sparkSession
    folder = work_folder(spark, name)
    rows.write.mode("errorifexists").options(**options).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder), folder


def settle(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder once and read it back.

    For a table that several branches of a plan start from: it is computed once, the
    lineage above it is cut, its size is known to the optimizer, and a lost executor
    rereads files instead of rerunning the branches. ``options`` are those of the writer.
    """
    return settled_folder(rows, name, **options)[0]


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``settled_folder`` made, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
