"""Metadata of chunks from file names and contents, flags, exports, and the choice among ways to split a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, lexicons as lx
from .folds import split_table_by_size
from .tables import split_by_items, split_by_periods


def enrich(chunks: DataFrame, display_name: str = "display_name") -> DataFrame:
    """``company_name``, ``company_code``, ``fiscal_year`` and ``report_type`` of chunks: what the file's name says wins over the content.

    A report type is replaced only where it is empty or the name of a section. Columns of these names are read and replaced; missing ones count as empty.
    """
    c, m = F.col("content"), F.col("_m")
    own = lambda name, kind="string": F.col(name) if name in chunks.columns else F.lit(None).cast(kind)
    said = lambda x: F.when(x != "", x)
    sections = (*lx.STATEMENTS, lx.NO_SECTION)
    kind = own("report_type")
    code = F.when(own("company_code").rlike("^[0-9]+$"), own("company_code"))
    return chunks.withColumn("_m", extract.filename_metadata(F.col(display_name))).withColumns(
        {
            "company_name": F.coalesce(m["company_name"], said(own("company_name")), extract.company_name(c)),
            "company_code": F.coalesce(m["company_code"], code, extract.stock_code(c, bare=False)),
            "fiscal_year": F.coalesce(m["fiscal_year"], own("fiscal_year", "int"), extract.fiscal_year(c)),
            "report_type": F.when(m["report_type"].isNotNull() & (kind.isNull() | (kind == "") | kind.isin(*sections)), m["report_type"]).otherwise(kind),
        }
    ).drop("_m")


def report_year(chunks: DataFrame, *keys: str, order: str = "seq", display_name: str = "display_name") -> DataFrame:
    """``(keys, fiscal_year)``: the year of the first chunk that has one, else a year in the file's name."""
    first = F.min(F.when(F.col("fiscal_year").isNotNull(), F.struct(order, "fiscal_year")))["fiscal_year"]
    return chunks.groupBy(*keys).agg(F.coalesce(first, extract.year_of_filename(F.first(display_name, ignorenulls=True))).alias("fiscal_year"))


def enhanced(tables: DataFrame) -> DataFrame:
    """Tables with ``table_type``, a quality raised by a tenth where there is a type, and ``high_value`` for good or typed ones."""
    kind = extract.table_type(F.col("content"))
    out = tables.withColumn("table_type", kind).withColumn("quality", F.when(F.col("table_type").isNotNull(), F.least(F.lit(1.0), F.col("quality") + 0.1)).otherwise(F.col("quality")))
    return out.withColumn("high_value", (F.col("quality") > 0.8) | F.col("table_type").isNotNull())


def low_quality(rows: Column, cols: Column, quality: Column, least: float = 0.65) -> Column:
    """Tables that call for another detector: too few rows or columns, or too poor."""
    return (rows < 2) | (cols < 2) | (quality < least)


def numeric_summary(values: Column | None = None) -> Column:
    """The summary of a table's figures in chunk metadata: zeros, as no path fills it, unless figures are given."""
    zero = F.struct(F.lit(0).alias("count"), F.lit(0.0).alias("min"), F.lit(0.0).alias("max"), F.lit(False).alias("has_negative"), F.lit(False).alias("has_percentage"))
    return zero if values is None else F.coalesce(values, zero)


def split_table(lines: DataFrame, meta: DataFrame, child_size: int = 1200, key: str = "table_id") -> DataFrame:
    """``(key, part_no, how, content)`` of tables ``lines(key, line_no, line)``: by accounting items where ``meta(key, items, periods)`` has some,
    else by periods where it has some, else by size."""
    m = meta.select(key, F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("periods", F.array().cast("array<string>")).alias("periods"))
    both = lines.join(m, key, "left").withColumn("how", F.when(F.size("items") > 0, "items").when(F.size("periods") > 0, "periods").otherwise("size"))
    joined = lambda df, *k: df.groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    a = both.where("how = 'items'")
    by_items = joined(split_by_items(a.select(key, "line_no", "line"), m.select(key, "items"), key), key, "part_no").select(key, F.col("part_no").cast("int").alias("part_no"), F.lit("items").alias("how"), "content")
    p = both.where("how = 'periods'")
    n, w = F.size("periods"), Window.partitionBy(key)
    each = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n))
    part = F.least(F.floor((F.row_number().over(w.orderBy("line_no")) - 1) / each), n - 1).cast("int")
    by_periods = joined(p.withColumn("part_no", part), key, "part_no").select(key, "part_no", F.lit("periods").alias("how"), "content")
    by_size = split_table_by_size(both.where("how = 'size'").select(key, "line_no", "line"), child_size, (key,)).select(key, "part_no", F.lit("size").alias("how"), "content")
    return by_items.union(by_periods).union(by_size)


def preview(chunks: DataFrame, tables_only: bool = False, sections: bool = False, children: bool = False) -> DataFrame:
    """Chunks of a review: parents, with children and section nodes only if asked, or tables alone."""
    out = chunks if children else chunks.where("layer = 'parent'")
    out = out if sections else out.where("chunk_type <> 'section'")
    return out.where("is_table or chunk_type = 'table_group'") if tables_only else out


def export_rows(chunks: DataFrame) -> DataFrame:
    """Flat rows for a spreadsheet, one for each chunk."""
    return chunks.select(
        "layer",
        "chunk_id",
        "chunk_type",
        (F.coalesce("is_table", F.lit(False)) | (F.col("chunk_type") == "table_group")).alias("is_table"),
        F.array_min(F.concat(F.coalesce("page_numbers", F.array().cast("array<int>")), F.array("page_number"))).alias("entry_page"),
        F.array_join("page_numbers", ",").alias("page_numbers"),
        F.coalesce("position", F.lit(0)).alias("position"),
        F.coalesce(F.size("child_ids"), F.lit(0)).alias("child_count"),
        F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.length(F.coalesce("content", F.lit(""))).alias("content_len"),
        F.coalesce("content", F.lit("")).alias("content"),
    )
