"""One query for each operator of this subpackage, over its whole table, and the SQL that tells its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, line_dedup, lm_score, mixture, near_dup, suffix_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.col("pred_lang").alias("language"), F.col("lang_score").alias("score"), F.col("lang_kept").alias("kept"))


def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_plan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.events_of_turns(_table(spark, sf_dir, "conversations")))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors.where(F.col("vec_id") % topk.QUERY_IDS == 0), vectors).withColumn("distance", F.round("distance", 6))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_line_dedup, op3_language_id, op4_source_mixture, op5_chat_format,
        op6_exact_topk, op7_lm_score, op8_minhash_dedup, op9_suffix_dedup, op10_decontamination,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op4_source_mixture": mixture.SQL, "op5_chat_format": chat.SQL, "op6_exact_topk": topk.SQL}
