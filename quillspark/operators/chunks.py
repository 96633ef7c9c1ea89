"""Operators over parent and child chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import review_snippet, snippet, strip


def quality_filter(chunks: DataFrame, least_quality: float = 0.3, least_size: int = 50) -> DataFrame:
    """Chunks of enough quality and size; section nodes are exempt."""
    good = (F.col("quality") >= least_quality) & (F.length(strip(F.col("content"))) >= least_size)
    return chunks.where((F.col("chunk_type") == "section") | good)


def links(children: DataFrame, *keys: str) -> DataFrame:
    """``(parent_id, child_ids)``: ids in the order of positions. Short ids repeat among documents: ``keys`` are what else tells parents apart."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"])
    return children.groupBy(*keys, "parent_id").agg(ordered.alias("child_ids"))


def siblings(children: DataFrame, *keys: str) -> DataFrame:
    """Children with ``sibling_ids``: their parent's other children."""
    return children.join(links(children, *keys), [*keys, "parent_id"]).withColumn("sibling_ids", F.array_remove("child_ids", F.col("chunk_id"))).drop("child_ids")


def dangling(parents: DataFrame, children: DataFrame) -> DataFrame:
    """``(parent_id, child_id)`` of references to children that a filter took away.

    Short ids repeat among the children of many parents, so a reference is met by a child of its own parent only, and each by another child.
    """
    named = parents.select("parent_id", F.explode("child_ids").alias("child_id"))
    return named.exceptAll(children.select("parent_id", F.col("chunk_id").alias("child_id")))


def page_ranges(pages: DataFrame, *keys: str, page: str = "page") -> DataFrame:
    """``(keys, first_page, last_page)`` of runs of consecutive pages; repeats count once, nulls not at all."""
    one = pages.where(F.col(page).isNotNull()).select(*keys, page).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page))
    return one.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page")).drop("_island")


def grade(quality: Column) -> Column:
    return F.when(quality >= 0.8, "high").when(quality >= 0.5, "medium").otherwise("low")


def overview(chunks: DataFrame, *keys: str) -> DataFrame:
    """Counts of parents, children and pages, quality grades, and children to a parent (rounded half to even) for each document."""
    is_parent = F.col("layer") == "parent"
    count = lambda g: F.count_if(grade(F.col("quality")) == g).alias(g)
    out = chunks.groupBy(*keys).agg(F.count_if(is_parent).alias("parents"), F.count_if(~is_parent).alias("children"), F.count_distinct("page").alias("pages"), *(count(g) for g in ("high", "medium", "low")))
    return out.withColumn("avg_children", F.when(F.col("parents") > 0, F.bround(F.col("children") / F.col("parents"), 2)).otherwise(0.0))


def largest(parents: DataFrame, *keys: str, k: int = 5, size: int = 120) -> DataFrame:
    """The ``k`` longest parents of each document with a preview; ties in the order of ``seq``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.length("content").desc(), "seq"))
    return parents.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "seq", F.length(strip(F.col("content"))).alias("chars"), snippet(F.col("content"), size).alias("preview"))


def deduplicate(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The first row of each content in the order given, null orders last; contents compare by digest, null as ''.

    Rows of one content that tie in order are settled by a hash of the whole row. One aggregate that combines before it shuffles, so a
    content that many rows share costs little.
    """
    row = F.struct(*rows.columns)
    by = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("order"), F.xxhash64(*rows.columns).alias("tie"))
    return rows.groupBy(F.md5(F.coalesce(column, F.lit(""))).alias("_digest")).agg(F.min_by(row, by).alias("_row")).select("_row.*")


def overlapping(spans: DataFrame, key: str, threshold: float = 0.1) -> DataFrame:
    """``(key, a, b)`` of spans ``(key, pos, start, end)`` of one document that overlap by more than a share of the shorter.

    Spans meet in buckets as wide as the document's widest span, so each is compared with near ones only.
    """
    width = F.greatest(F.lit(1), F.max(F.col("end") - F.col("start")).over(Window.partitionBy(key)))
    s = spans.where(F.col("end") > F.col("start")).withColumn("_w", width)
    bucket = F.floor(F.col("start") / F.col("_w"))
    left = s.select(key, F.col("pos").alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    right = s.select(key, F.col("pos").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"), bucket.alias("_b"))
    both = F.least("e1", "e2") - F.greatest("s1", "s2")
    return left.join(right, [key, "_b"]).where((F.col("a") < F.col("b")) & (both > 0) & (both / F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2")) > threshold)).select(key, "a", "b")


#: Spans of one ``pos`` that are compared pair by pair; more are counted like a document's.
_FEW = 16


def _above(order: np.ndarray, values: np.ndarray, upto: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query, how many of the first ``upto`` values in ``order`` are ``least`` or more: bits of the values' ranks, one level at a time."""
    at = np.sort(values)
    rank, want = at.searchsorted(values[order]), at.searchsorted(least)
    count, low, high = np.zeros(len(upto), np.int64), np.zeros(len(upto), np.int64), upto.copy()
    # a rank that no value has: nothing is as large
    none = want >= len(values)
    for bit in reversed(range(max(1, int(len(values)).bit_length()))):
        one = (rank >> bit) & 1
        ones = np.concatenate([[0], np.cumsum(one)])
        zeros, set_ = len(rank) - ones[-1], ((want >> bit) & 1).astype(bool)
        one_low, one_high = ones[low], ones[high]
        count += np.where(set_, 0, one_high - one_low)
        low, high = np.where(set_, zeros + one_low, low - one_low), np.where(set_, zeros + one_high, high - one_high)
        rank = np.concatenate([rank[one == 0], rank[one == 1]])
    return np.where(none, 0, count + high - low)


def count_overlaps(start: np.ndarray, end: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """For each span (of whole numbers, ``end`` after ``start``), how many spans overlap it by more than a share of the shorter; itself counts.

    With ``k`` the least length that is more than the share of a span of length ``n``: a span misses the ones that are no longer than it if they begin
    beyond its end less their ``k`` or end before its start and their ``k``, and longer ones likewise with its own ``k``. No span does both, so
    two counts of each are taken from all, in time that grows as n log n.
    """
    n = end - start
    k = np.floor(threshold * n).astype(np.int64) + 1
    for step in (-1, -1, 1, 1):
        # floating-point division decides, as in SQL
        move = (k > 1) & ((k - 1) / n > threshold) if step < 0 else ~(k / n > threshold)
        k = np.where(move, k + step, k)
    order = np.argsort(n, kind="stable")
    shorter = n[order].searchsorted(n, "right")
    longer = len(n) - shorter
    missed = _above(order, start + k, shorter, end + 1) + _above(order, k - end, shorter, 1 - start)
    back = order[::-1]
    missed += _above(back, start, longer, end - k + 1) + _above(back, -end, longer, 1 - start - k)
    return len(n) - missed


def overlap_counts(spans: DataFrame, key: str, threshold: float = 0.1) -> DataFrame:
    """``(key, pos, class_id, links)`` of spans ``(key, pos, start, end)``: a row for each span, with the number of spans of other ``pos`` in its
    document that overlap it by more than a share of the shorter, and the least ``pos`` of the spans that are equal to it.

    The pairs themselves grow with the square of a document's spans, see :func:`overlapping`. Spans without extent, ``pos`` or key have no links.
    """
    if not 0 <= threshold < 0.5:
        raise ValueError("the threshold is a share of the shorter span, from 0 to less than a half")
    fields = {f.name: f for f in spans.schema.fields}
    out = T.StructType([fields[key], fields["pos"], T.StructField("class_id", fields["pos"].dataType), T.StructField("links", T.LongType())])
    arrow = to_arrow_schema(out)

    def count(page: pa.Table) -> pa.Table:
        page = page.sort_by([("start", "ascending"), ("end", "ascending"), ("pos", "ascending")])
        real = np.flatnonzero(pc.and_(pc.greater(page["end"], page["start"]), pc.and_(page["pos"].is_valid(), page[key].is_valid())).fill_null(False).to_numpy())
        links = np.zeros(len(page), np.int64)
        some = page.take(pa.array(real))
        start, end, pos = (some[c].to_numpy() for c in ("start", "end", "pos"))
        if len(real):
            # spans of one pos are no pairs
            order = np.argsort(pos, kind="stable")
            cuts = np.flatnonzero(pos[order][1:] != pos[order][:-1]) + 1
            own = np.ones(len(real), np.int64)
            bounds = np.concatenate([[0], cuts, [len(order)]])
            size = np.diff(bounds)
            for i in np.flatnonzero(size > _FEW).tolist():
                group = order[bounds[i] : bounds[i + 1]]
                own[group] = count_overlaps(start[group], end[group], threshold)
            left = np.repeat(np.where(size > _FEW, 0, bounds[1:]), size) - np.arange(len(order))
            for step in range(1, min(int(size.max()), _FEW)):
                i = np.flatnonzero(left > step)
                a, b = order[i], order[i + step]
                both = np.minimum(end[a], end[b]) - np.maximum(start[a], start[b])
                linked = (both > 0) & (both / np.minimum(end[a] - start[a], end[b] - start[b]) > threshold)
                own[a[linked]] += 1
                own[b[linked]] += 1
            links[real] = count_overlaps(start, end, threshold) - own
        # rows are sorted: equal spans lie together, the least pos first and nulls last
        both = [page[c].combine_chunks() for c in ("start", "end")]
        new = np.ones(len(page), bool)
        for_all = [c.fill_null(np.iinfo(np.int64).min).to_numpy() for c in both]
        new[1:] = (for_all[0][1:] != for_all[0][:-1]) | (for_all[1][1:] != for_all[1][:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        return pa.table([page[key], page["pos"], page["pos"].take(pa.array(head)), pa.array(links)], names=out.names).cast(arrow)

    rows = spans.select(key, "pos", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    return rows.groupBy(key).applyInArrow(count, out)


def review(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks in the order of review (first page, top, position; unknown ones last) under the display name of their source."""
    named = chunks.join(sources.select("source_ref", "display_name"), "source_ref", "left")
    far = F.lit(float("inf"))
    top = F.coalesce(F.col("y0"), far)
    page = F.coalesce(F.array_min(F.concat(F.coalesce("page_numbers", F.array().cast("array<int>")), F.array("page_number"))).cast("double"), far)
    return named.select(F.coalesce("display_name", "source_ref", F.lit("unknown")).alias("source"), page.alias("entry_page"), top.alias("top"), F.coalesce("position", F.lit(0)).alias("position"), "chunk_id", review_snippet(F.col("content")).alias("snippet"))


def processing_summary(chunks: DataFrame) -> DataFrame:
    """One row: counts by layer, characters, mean quality and the shares of tables and of financial chunks as percentages."""
    share = lambda c: F.format_string("%.1f%%", F.avg(F.col(c).cast("int")) * 100)
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("layer") == "parent").alias("parents"), F.sum(F.length("content")).alias("chars"), F.avg("quality").alias("mean_quality"), share("is_table").alias("table_share"), share("financial").alias("financial_share"))
