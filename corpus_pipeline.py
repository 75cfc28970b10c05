"""Corpus preparation in five stages; each takes and returns a table of documents.

Toxic documents go, lines of recurring templates are cut, one document of each group of
near-duplicates stays (the least id), documents that hold benchmark windows go, and what
is left is encoded. Every stage works on all rows it is given, keeps every column of them, and
treats equal rows alike, but that near-dedup keeps one of them. Columns beside ``doc_id``
and ``text`` may have any names. A null text is an empty one for every decision and stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from tracegauge.llm import bpe, decontam, lines, simhash, toxicity
from tracegauge.llm.common import table
from tracegauge.llm.queries import vocabulary_path

TOXIC = 0.5


def _plain(docs: DataFrame) -> DataFrame:
    """Other columns under names that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__other{i}" for i, c in enumerate(docs.columns)])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in order and by their names, and those that a stage added."""
    plain = _plain(docs).columns
    return rows.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns)], *[F.col(c) for c in rows.columns if c not in plain and not c.startswith("__")])


def _keyed(docs: DataFrame) -> DataFrame:
    """With the hash that, beside ``doc_id``, tells rows apart where they differ."""
    return _plain(docs).withColumn("__key", F.xxhash64("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _plain(docs)
    model = toxicity.train(rows, table(spark, sf_dir, "labels"), F.lit(True))
    scored = model.score(rows, tuple(rows.columns))
    return _named(scored.where(F.col("score") < TOXIC).drop("score"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = _named(lines.drop_lines(_plain(docs)).withColumnRenamed("n_dropped", "__dropped").drop("n_lines"), docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    found = simhash.near_duplicates(rows, ("doc_id", "__key"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("__key"))).alias("k"))
    stay = first.select(F.coalesce("k.doc_id", F.lit(0)).alias("__id"), F.col("k.no_id").alias("__no_id"), F.col("k.__key").alias("__key"))
    rows = rows.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__no_id", F.col("doc_id").isNull())
    kept = rows.join(stay, ["__id", "__no_id", "__key"], "left_semi")
    others = [c for c in _plain(docs).columns if c not in ("doc_id", "text")]
    one = W.partitionBy("__id", "__no_id", "__key").orderBy(F.xxhash64(*others) if others else F.lit(0))
    return _named(kept.withColumn("__n", F.row_number().over(one)).where("__n = 1"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    found = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=("doc_id", "__key"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__hash")).distinct()
    return _named(rows.join(hit, rows["doc_id"].eqNullSafe(hit["__id"]) & (rows["__key"] == hit["__hash"]), "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _plain(docs)
    made = bpe.encode_decode(rows, vocabulary_path(), tuple(rows.columns))
    return _named(made.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded"), docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
