"""Input files: listing, name lists, path resolution and incremental selection."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, folders: list[str], pattern: str = "*.pdf", content: bool = False) -> DataFrame:
    """``(path, length)`` and, if asked, ``content`` of the files of the folders that exist, not of folders below them.

    The binary reader lists files on the executors' file system and reads contents only where they are selected.
    """
    columns = ["path", "length", *(["content"] if content else [])]
    there = [f for f in folders if "://" in f or os.path.isdir(f)]
    if not there:
        return spark.createDataFrame([], "path string, length long" + (", content binary" if content else ""))
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(there).select(*columns)


def listed_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(ord, name)`` of the lines of a list file that are neither blank nor comments, in the order of ``ord``."""
    name = F.btrim(F.col(column), F.lit(" \t\r\n"))
    return lines.withColumn("name", name).where((F.col("name") != "") & ~F.startswith(F.col("name"), F.lit("#"))).select("ord", "name")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    return listed_names(lines)


def names_of(spark: SparkSession, names: str) -> DataFrame:
    """``(ord, name)`` from names joined by commas."""
    one = spark.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("ord", "value"))
    return one.select("ord", F.trim("value").alias("name")).where("name <> ''")


def resolve(names: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """``(ord, name, path)`` of names ``(ord, name)`` in folders ``(dir_ord, dir)`` among files ``(path)``.

    A name with a separator is a path itself. Others are looked for as they are, then with ``.pdf``, folder by folder; the first that exists wins,
    and names found nowhere are left out.
    """
    is_path = F.col("name").rlike(r"[/\\]")
    variants = F.array(F.struct(F.lit(0).alias("variant"), F.lit("").alias("suffix")), F.struct(F.lit(1).alias("variant"), F.lit(".pdf").alias("suffix")))
    direct = names.where(is_path).select("ord", "name", F.lit(0).alias("dir_ord"), F.lit(0).alias("variant"), F.col("name").alias("path"))
    searched = names.where(~is_path).crossJoin(folders).withColumn("v", F.explode(variants)).select("ord", "name", "dir_ord", "v.variant", F.concat("dir", F.lit("/"), "name", "v.suffix").alias("path"))
    found = direct.union(searched).join(files.select("path").distinct(), "path")
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("dir_ord", "variant"))
    return found.withColumn("_r", rank).where("_r = 1").select("ord", "name", "path")


def first_of_each(paths: DataFrame) -> DataFrame:
    """Every path once, at its first place."""
    return paths.groupBy("path").agg(F.min("ord").alias("ord"))


def not_done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(outputs.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def catalog(paths: DataFrame) -> DataFrame:
    """``(source_ref, relative_path, display_name, path_md5)`` of each path; the reference is drawn from the path's digest."""
    digest = F.md5("path")
    return paths.select(F.concat(F.lit("src-"), F.substring(digest, 1, 8)).alias("source_ref"), F.col("path").alias("relative_path"), F.substring_index("path", "/", -1).alias("display_name"), digest.alias("path_md5"))


def page_kinds(pages: DataFrame, *keys: str, text_least: int = 80, sparse: int = 20, image_least: float = 0.7) -> DataFrame:
    """``(keys, pages, text_share, scan_share, pdf_type)`` from pages ``(keys, text_chars, image_ratio)``: digital, scanned, mixed or unknown."""
    flag = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("int"))
    out = pages.groupBy(*keys).agg(F.count("*").alias("pages"), flag(F.col("text_chars") >= text_least).alias("text_share"), flag((F.col("text_chars") <= sparse) & (F.col("image_ratio") >= image_least)).alias("scan_share"))
    text, scan_ = F.col("text_share"), F.col("scan_share")
    # 1 - 0.8 is less than 0.2 in binary arithmetic; the bound is kept as it is computed
    rest = 1 - 0.8
    kind = F.when((scan_ >= 0.8) & (text <= rest), "scanned").when((text >= 0.8) & (scan_ <= rest), "digital").otherwise("mixed")
    return out.withColumn("pdf_type", kind)


ENGINES = {"digital": ("pdfplumber", "pymupdf", "unstructured"), "scanned": ("unstructured", "pdfplumber"), "mixed": ("hybrid_table", "unstructured", "pdfplumber")}


def engine(pdf_type: Column, available: list[str]) -> Column:
    """Reader for a kind of file: the first of its preferences that is available, else any."""
    pick = lambda names: next((n for n in names if n in available), available[0] if available else None)
    out = None
    for kind, names in ENGINES.items():
        out = F.when(pdf_type == kind, F.lit(pick(names))) if out is None else out.when(pdf_type == kind, F.lit(pick(names)))
    return out.otherwise(F.lit(pick(ENGINES["mixed"])))


def first_success(results: DataFrame, *keys: str) -> DataFrame:
    """Rows of the first strategy, by ``priority``, that gave any row for a key: the fallback from one reader to the next."""
    best = results.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return results.join(best, [*keys, "priority"], "left_semi")
