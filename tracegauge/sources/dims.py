"""Small documents that become dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RATE = "struct<input_usd_per_mtok:double,output_usd_per_mtok:double,verified:boolean,source:string>"
PRICES = f"struct<manifest_date:string,revision:int,currency:string,supersedes:string,models:map<string,{RATE}>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its text; these documents are small by nature."""
    return spark.read.text(path, wholetext=True)


def price_rows(files: DataFrame) -> DataFrame:
    """(manifest_date, revision, model_id, rates) from price documents in ``value``."""
    doc = files.select(F.from_json("value", PRICES, {"mode": "FAILFAST"}).alias("d"))
    return doc.select("d.manifest_date", "d.revision", F.explode("d.models").alias("model_id", "r")).select(
        "manifest_date",
        "revision",
        "model_id",
        F.col("r.input_usd_per_mtok").alias("in_rate"),
        F.col("r.output_usd_per_mtok").alias("out_rate"),
        F.coalesce("r.verified", F.lit(False)).alias("verified"),
        F.coalesce("r.source", F.lit("")).alias("source"),
    )


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    return price_rows(whole_files(spark, path))


SPLITS = "struct<seed:bigint,dev:array<string>,validation:array<string>,test:array<string>,dataset_sha256:string>"
SPLIT_NAMES = ("dev", "validation", "test")


def split_rows(files: DataFrame) -> DataFrame:
    """(template_family, split) from split documents."""
    doc = files.select(F.from_json("value", SPLITS, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    long = doc.unpivot([], list(SPLIT_NAMES), "split", "units")
    return long.select(F.explode("units").alias("template_family"), "split")


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    return split_rows(whole_files(spark, path))


def units_of(split_unit: DataFrame, split: str) -> DataFrame:
    if split not in SPLIT_NAMES:
        raise ValueError(f"unknown split {split!r}; known: {SPLIT_NAMES}")
    return split_unit.where(F.col("split") == split).select("template_family")


def question_rows(files: DataFrame) -> DataFrame:
    """One row per judge question: key, canonical text and its length."""
    from ..functions.text import canonical_json

    doc = files.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return doc.select(F.explode("m").alias("question", "body")).select(
        "question", canonical_json(F.col("body")).alias("body")
    ).withColumn("chars", F.length("body"))


def longest_question(questions: DataFrame) -> DataFrame:
    return questions.agg(F.coalesce(F.max("chars"), F.lit(0)).alias("longest_question_chars"))
