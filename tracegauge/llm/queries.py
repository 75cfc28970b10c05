"""Thin queries over the given tables; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, decontam, langid, lines, lm, phrases, rankbpe, resample, runindex, simhash, substring, toxicity
from .checks import CHECKS
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(documents(spark, sf_dir), vocabulary_path())
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(documents(spark, sf_dir))
    return made.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontam.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return made.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    made = model.score(docs)
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    made = langid.predict(docs, langid.train(docs, ~held))
    return made.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op4_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = documents(spark, sf_dir), crc_mod(F.col("doc_id"), 10)
    made = lm.score(docs, F.coalesce(remainder != 0, F.lit(False)))
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring.remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runindex.remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return made.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return made.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = phrases.top(phrases.collocations(documents(spark, sf_dir), least=100, longest=5, share=100), 2000)
    return made.select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query
def op13_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = rankbpe.encode_decode(documents(spark, sf_dir), vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
