"""Chunk files: one JSON document for each source, and native tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(parents: DataFrame, children: DataFrame, overview: DataFrame, key: str = "source_ref") -> DataFrame:
    """``(key, json)``: overview, parents and children of each source, with null fields kept.

    Chunks are collected for each source as the format asks for one document; for processing on, :func:`write_tables` keeps them as rows.
    """
    order = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in df.columns if c not in (key, "seq")]))).alias(name))
    out = overview.select(key, F.struct(*[c for c in overview.columns if c != key]).alias("overview"))
    out = out.join(order(parents, "parents"), key, "left").join(order(children, "children"), key, "left")
    return out.select(key, F.to_json(F.struct(F.col(key).alias("source"), "overview", "parents", "children"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(docs: DataFrame, path: str) -> None:
    docs.select("json").write.mode("overwrite").text(path)


def read_chunks(spark: SparkSession, path: str, layer: str, fields: str) -> DataFrame:
    """The chunks of one layer (``parents`` or ``children``) as rows of ``fields``; files may be one document to a line."""
    docs = spark.read.schema(f"source string, {layer} array<struct<{fields}>>").json(path)
    return docs.select("source", F.explode(layer).alias("c")).select("source", "c.*")


def write_tables(parents: DataFrame, children: DataFrame, path: str, run: str | None = None) -> None:
    """Parquet tables below ``path``, partitioned by layer, and by run if one is named."""
    both = parents.withColumn("layer", F.lit("parent")).unionByName(children.withColumn("layer", F.lit("child")), allowMissingColumns=True)
    keys = ["layer"]
    if run:
        both, keys = both.withColumn("run", F.lit(run)), ["run", "layer"]
    both.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(chunks: DataFrame, path: str) -> None:
    """Flat columns for a spreadsheet; arrays are joined by commas."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in chunks.dtypes]
    chunks.select(*flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
