"""What the corpus operators share: reading, settled tables, and row-wise Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegauge.session import work_folder

from .kernels import buffers, chunks

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def lean_jobs(spark: SparkSession):
    """Jobs that end in this block drop their shuffle files, and pass texts to Python a thousand at a time."""
    own = {CLEANUP: "true", BATCH_ROWS: "1000"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder, drop the shuffles that made it, and read it back.

    It cuts lineage and bounds the disk: only settled tables live on between jobs, and a
    lost executor rereads files that every machine sees.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, name)
    with lean_jobs(spark):
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; null where the column is null."""
    return F.crc32(column.cast("string").cast("binary")) % n


MAP_BYTES = 1 << 20


def map_texts(docs: DataFrame, keep: list[str], text: str, fn: Callable, schema: str) -> DataFrame:
    """One output row per input row: the kept columns and what ``fn`` gives for a chunk of texts.

    ``fn(data, offsets) -> list of arrays``, in the order of ``schema`` after the kept
    columns. A chunk is about a megabyte of whole texts; a null text is an empty one. A kept
    string column that is the text itself goes to Python once.
    """
    own = text in keep and docs.schema[text].dataType.simpleString() == "string"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if own else [F.col(f"`{text}`").cast("string").alias("__text")]))
    place = keep.index(text) if own else len(keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(place))
            for a, b in chunks(offsets, MAP_BYTES):
                made = fn(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(keep))], *map(pa.array, made)], names=[*keep, *names])

    return rows.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


SLOT_BYTES = 4096


def slot_bitmap(hashes: DataFrame, column: str, bits: int):
    """A broadcast bitmap of the top ``bits`` bits of 64-bit hashes: 2 ** bits / 8 bytes, however many hashes there are.

    A prefilter only: it passes every hash of the table and, the fuller it is, more others.
    """
    import numpy as np

    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    width = SLOT_BYTES * 8
    parts = hashes.groupBy((slot / width).cast("long").alias("part")).agg(F.bitmap_construct_agg(slot % width).alias("set"))
    bitmap = np.zeros((max(1, (1 << bits) // width), SLOT_BYTES), np.uint8)
    for part, own in parts.collect():
        bitmap[part] = np.frombuffer(own, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bitmap.ravel())
