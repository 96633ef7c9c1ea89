"""From raw documents to a training mixture: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import remove_leaks
from quillspark.llm.language import identify
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.mixture import mix_sources
from quillspark.llm.near_dup import dedup_near
from quillspark.staging import stage


def _apply(docs: DataFrame, added: set[str], keep: str, operator, values: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` after ``operator``, in rows where ``keep`` holds, with new ``values`` for some.

    Columns of ``docs`` named like one that the operator adds are set aside meanwhile, so none is lost.
    """
    taken, aside = {c.lower() for c in docs.columns} | added, {}
    for c in docs.columns:
        if c.lower() in added:
            aside[c] = next(n for n in (f"{c}_{k}" for k in range(len(taken) + 1)) if n.lower() not in taken)
            taken.add(aside[c].lower())
    found = operator(docs.withColumnsRenamed(aside)).where(keep)
    return found.select(*(values[c].cast(docs.schema[c].dataType).alias(c) if c in values else F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no recognisable language; set ``lang`` to the language found.

    Null, empty and letterless texts have none and go; null languages and ids do not matter; repeated rows stay as they are.
    """
    return _apply(docs, {"pred_lang", "lang_score", "lang_kept"}, "lang_kept", identify, {"lang": F.col("pred_lang")})


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later occurrences of lines out of the texts; drop documents that lose their last line by it.

    Null and empty texts lose nothing and stay; repeated rows of one id and text are cut alike, rows without id each for itself.
    """
    return _apply(docs, {"n_lines", "n_removed", "n_left"}, "n_removed = 0 or n_left > 0", dedup_lines, {"n_chars": F.length("text")})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates.

    Documents without id or words are in no group and stay; rows that repeat an id stay or go together.
    """
    return dedup_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take benchmark passages out of the texts; drop documents of which nothing else is left.

    Null and empty texts have no passages and stay; repeated rows are cut alike.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apply(docs, {"n_leaks"}, r"n_leaks = 0 or text rlike '\\S'", lambda d: remove_leaks(d, bench), {"n_chars": F.length("text")})


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal token shares for all sources; ``copies`` says how often each drawn document occurs in the mixture.

    Documents without id or words are not drawn, of rows that repeat an id one is; a null source is one of its own; a column ``copies`` is replaced.
    """
    return mix_sources(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: Language models, hashed signatures and an automaton are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result of each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
