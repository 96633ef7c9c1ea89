"""Operators over the ordered elements of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, headings, lexicons, scores, text


def typed(elements: DataFrame, declared: str | None = None) -> DataFrame:
    return elements.withColumn("element_type", headings.element_type(F.col("content"), F.col(declared) if declared else None))


def drop_noise(elements: DataFrame) -> DataFrame:
    """Without running heads and feet and empty elements; heads glued to a text are cut off it."""
    kept = elements.where(~text.is_header_noise(F.coalesce("content", F.lit("")))).withColumn("content", text.drop_header_prefix(F.col("content")))
    return kept.where("content <> ''")


def annotate(elements: DataFrame) -> DataFrame:
    """Company, stock code, fiscal period, section, statement, accounting items and dates of each element; nulls where there are none."""
    c = F.col("content")
    return elements.withColumns(
        {
            "company_name": extract.company_name(c),
            "stock_code": extract.stock_code(c),
            "fiscal_period": extract.fiscal_period(c),
            "report_section": extract.report_section(c),
            "financial_statement": extract.statement_name(c),
            "accounting_items": extract.element_items(c),
            "fiscal_dates": extract.fiscal_dates(c),
        }
    )


def carry_section(elements: DataFrame) -> DataFrame:
    """``section``: the last statement named up to the element, and ``section_rank``: the place of the section's first element; the unnamed section is first."""
    named = extract.first_listed(F.col("content"), lexicons.STATEMENTS, 100)
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = elements.withColumn("section", F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit(lexicons.NO_SECTION)))
    first = F.min("seq").over(Window.partitionBy("doc_id", "section"))
    return out.withColumn("section_rank", F.when(F.col("section") == lexicons.NO_SECTION, -1).otherwise(first))


def split_paragraphs(pages: DataFrame, column: str = "content", least: int = 10) -> DataFrame:
    """Paragraphs of at least ``least`` stripped characters, numbered by ``para_no`` as they stood."""
    parts = pages.select(*[c for c in pages.columns if c != column], F.posexplode(text.paragraphs(F.col(column))).alias("para_no", column))
    return parts.where(F.length(text.strip(F.col(column))) >= least)


def extraction_stats(elements: DataFrame, *keys: str) -> DataFrame:
    """Counts by type, share with a box, mean quality and share above 0.8."""
    count = lambda k: F.count_if(F.col("element_type") == k).alias(f"n_{k}")
    return elements.groupBy(*keys).agg(F.count("*").alias("n"), *(count(k) for k in ("title", "table", "list", "text")), F.avg(F.col("has_box").cast("int")).alias("box_share"), F.avg("quality").alias("mean_quality"), F.avg((F.col("quality") > 0.8).cast("int")).alias("high_share"))


def with_quality(elements: DataFrame) -> DataFrame:
    return elements.withColumn("quality", scores.element_quality(F.col("content")))


def section_tree(parents: DataFrame, parent_size: int = 4000) -> DataFrame:
    """Level, title and path of the section that each parent chunk ``(doc_id, seq, content)`` lies in, and the place of the section's heading.

    The section of a level is open while its heading is later than every heading of a lesser level; this replaces a stack of
    sections, as there are four levels only. Adds heading_level, section_level, section_title, section_path, section_seq,
    parent_section_seq and is_complete_section.
    """
    c = F.col("content")
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = parents.withColumns({"heading_level": headings.heading_level(c), "_title": headings.heading_title(c)})
    for k in range(1, 5):
        own = F.when(F.col("heading_level") == k, F.struct("seq", "_title"))
        out = out.withColumn(f"_l{k}", F.last(own, ignorenulls=True).over(w))
    seq = [F.col(f"_l{k}.seq") for k in range(1, 5)]
    opened = [F.col("_l1").isNotNull()]
    for k in range(1, 4):
        opened.append(seq[k].isNotNull() & (seq[k] > F.coalesce(F.greatest(*seq[:k], F.lit(-1)), F.lit(-1))))
    levels = F.filter(F.array(*(F.when(o, F.struct(F.lit(k).alias("level"), F.col(f"_l{k}.seq").alias("seq"), F.col(f"_l{k}._title").alias("title"))) for k, o in enumerate(opened, 1))), lambda x: x.isNotNull())
    out = out.withColumn("_open", levels)
    last, above = F.try_element_at("_open", F.lit(-1)), F.try_element_at("_open", F.lit(-2))
    out = out.withColumns(
        {
            "section_level": F.coalesce(last["level"], F.lit(0)),
            "section_title": last["title"],
            "section_path": F.array_join(F.transform("_open", lambda x: x["title"]), " / "),
            "section_seq": last["seq"],
            "parent_section_seq": above["seq"],
            "is_complete_section": F.when(F.col("heading_level").isNotNull(), F.length(c) <= parent_size),
        }
    )
    return out.drop("_title", "_open", *(f"_l{k}" for k in range(1, 5)))


def inherit_section(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with the section of their parent where they have none of their own; children of unknown parents stay as they are."""
    p = parents.select(F.col("chunk_id").alias("parent_id"), F.col("section_level").alias("_level"), F.col("section_title").alias("_title"), F.col("section_path").alias("_path"))
    own = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))
    return children.join(p, "parent_id", "left").withColumns(
        {
            "section_level": F.when(F.coalesce("section_level", F.lit(0)) > 0, F.col("section_level")).otherwise(F.coalesce("_level", F.lit(0))),
            "section_title": F.coalesce(own("section_title"), F.col("_title")),
            "section_path": F.coalesce(own("section_path"), F.col("_path")),
        }
    ).drop("_level", "_title", "_path")
