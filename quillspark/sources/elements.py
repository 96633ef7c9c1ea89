"""Reader registry for elements, and readers of the forms that need no document library.

A reader gives the table ``(source_ref, seq, element_type, content, page_number, x0, y0, x1, y1, confidence)``.
Readers of PDF files, OCR and layout models need libraries of their own; they are registered from outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headings, text

Reader = Callable[[SparkSession, str], DataFrame]
_readers: dict[str, Reader] = {}
EXTERNAL = ("pdfplumber", "pymupdf", "unstructured", "hybrid_table")
COLUMNS = ("source_ref", "seq", "element_type", "content", "page_number", "x0", "y0", "x1", "y1", "confidence")


def register(name: str, reader: Reader) -> None:
    _readers[name] = reader


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Elements by the reader named; readers that are known but not installed say so."""
    if name not in _readers:
        known = f"'{name}' reads with a library that is not part of this engine; register a reader for it" if name in EXTERNAL else f"no reader named '{name}'"
        raise ValueError(f"{known}; there are {sorted(_readers)}")
    return _readers[name](spark, path)


def _shaped(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    have = set(df.columns)
    return df.select(*(F.col(c) if c in have else none.alias(c) for c in COLUMNS))


def from_text(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Text files, a form feed ending each page: paragraphs of ``least`` characters and more, typed by their looks."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_ref"), F.posexplode(F.split("value", "\f")).alias("page", "body"))
    paras = pages.select("source_ref", (F.col("page") + 1).alias("page_number"), F.posexplode(text.paragraphs(F.col("body"))).alias("para", "content")).where(F.length(text.strip(F.col("content"))) >= least)
    seq = F.row_number().over(Window.partitionBy("source_ref").orderBy("page_number", "para")) - 1
    return _shaped(paras.withColumns({"seq": seq, "element_type": headings.element_type(F.col("content")), "confidence": F.lit(0.7)}))


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "source_ref string, seq int, element_type string, content string, page_number int, x0 double, y0 double, x1 double, y1 double, confidence double"
    return spark.read.schema(schema).json(path)


register("text", from_text)
register("parquet", from_parquet)
register("json", from_json)


def point_box(points: Column) -> Column:
    """Box of a cloud of points ``array<struct<x, y>>``."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def combined(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Texts and tables of a document in reading order by page and top; what has no box stands at the top of its page."""
    both = texts.withColumn("_k", F.lit(0)).unionByName(tables.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("source_ref").orderBy("page_number", F.coalesce("y0", F.lit(0.0)), "_k", "seq")
    return both.withColumn("seq", F.row_number().over(order) - 1).drop("_k")


def gated(texts: DataFrame, fallback: DataFrame, least: float = 0.5) -> DataFrame:
    """``texts``, and of ``fallback`` the pages on which no text has a quality above ``least``."""
    good = texts.where(F.col("quality") > least).select("source_ref", "page_number").distinct()
    return texts.unionByName(fallback.join(good, ["source_ref", "page_number"], "left_anti"), allowMissingColumns=True)


def read_each(spark: SparkSession, name: str, paths: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Elements of the paths that the reader takes, and ``(path, error)`` of those that it refuses; one bad path does not end the others.

    Only what a reader refuses when it is planned is told apart; bad records inside files are the file reader's own to skip or to mark.
    """
    good, bad = [], []
    for path in paths:
        try:
            good.append(read(spark, name, path))
        except Exception as e:  # noqa: BLE001 - each path is on its own
            bad.append((path, str(e).split("\n")[0]))
    out = None
    for df in good:
        out = df if out is None else out.unionByName(df)
    return out, spark.createDataFrame(bad, "path string, error string")
