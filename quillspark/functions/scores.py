"""Additive scores of texts, tables and chunks, all in double precision; a null text scores as an empty one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import all_matches, cjk_count, cjk_ratio, has_any, hits, let, strip, words_in

_ELEMENT_MARKS = r"[，。！？；：\"'（）【】《》、—…]"
_CHUNK_MARKS = r"[，。！？；：\"（）]"


def _cap(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def element_quality(c: Column) -> Column:
    """Length, share of Chinese, keywords and structure of an element; 0 below ten characters."""
    c = F.coalesce(c, F.lit(""))
    structure = F.when(c.rlike(_ELEMENT_MARKS), 0.5).otherwise(0.0) + F.when(c.rlike(r"[\n。]"), 0.5).otherwise(0.0)
    score = _cap(F.length(c) / 500) * 0.2 + cjk_ratio(c) * 0.3 + _cap(hits(c, lx.ELEMENT_KEYWORDS) / 3) * 0.2 + structure * 0.3
    return F.when(F.length(strip(c)) < 10, 0.0).otherwise(_cap(score))


def content_quality(c: Column) -> Column:
    """Length, share of Chinese and density of punctuation of a chunk."""
    c = F.coalesce(c, F.lit(""))
    n = F.length(c)
    marks = F.regexp_count(c, F.lit(_CHUNK_MARKS))
    return F.when(n > 0, _cap(n / 500) * 0.3 + cjk_count(c) / n * 0.4 + _cap(marks / (n / 50)) * 0.3).otherwise(0.0)


def chunk_quality(c: Column, weights: tuple[float, float, float, float] = (0.2, 0.2, 0.3, 0.3)) -> Column:
    """Weighted length step, share of Chinese, financial terms and structure."""
    c = F.coalesce(c, F.lit(""))
    n = F.length(c)
    size = F.when(n < 50, 0.2).when(n < 200, 0.5).when(n < 1000, 1.0).when(n < 2000, 0.8).otherwise(0.6)
    structure = F.when(c.rlike("[，。！？；：]"), 0.5).otherwise(0.0) + F.when(c.rlike(r"[\n。]"), 0.5).otherwise(0.0)
    parts = (size, cjk_ratio(c), _cap(hits(c, lx.FINANCIAL_TERMS) / 5), structure)
    total = parts[0] * weights[0]
    for p, w in zip(parts[1:], weights[1:], strict=True):
        total = total + p * w
    return F.when(n > 0, _cap(total)).otherwise(0.0)


def information_density(n_items: Column, c: Column) -> Column:
    """Ten items (keywords, entities, indicators) for each hundred characters are full density."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > 0, _cap(n_items / (F.length(c) / 100) / 10)).otherwise(0.0)


def _count_connectives(texts: pa.Array) -> pa.Array:
    """struct(total, kinds) of each text: connectives, and how many kinds of them occur."""
    total, kinds = [], []
    for c in texts.to_pylist():
        counts = [sum(map(c.count, group)) for group in lx.CONNECTIVES.values()]
        total.append(sum(counts)), kinds.append(sum(n > 0 for n in counts))
    return pa.StructArray.from_arrays([pa.array(total, pa.int32()), pa.array(kinds, pa.int32())], ["total", "kinds"])


def connector_score(c: Column) -> Column:
    """Connectives for each five hundred characters, and a tenth for each kind that occurs.

    Words are counted in Arrow batches: native counting by replacement writes the text anew for each of 45 words, and takes many times as long.
    """
    c = F.coalesce(c, F.lit(""))
    found = F.arrow_udf(_count_connectives, "total int, kinds int")(c)
    expected = F.greatest(F.lit(1.0), F.length(c) / 500)
    return _cap(_cap(found["total"] / expected) + F.least(F.lit(0.3), found["kinds"] * 0.1))


def _split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[。！？.!?]"), strip), lambda s: s != "")


def topics(c: Column) -> Column:
    """Distinct runs of two to four Chinese characters, read from left to right, without stop words."""
    return F.array_distinct(F.filter(all_matches(c, "[一-鿿]{2,4}"), lambda w: ~w.isin(*lx.STOP_WORDS)))


def topic_overlap(c: Column) -> Column:
    """Mean Jaccard similarity of neighbouring sentences' topics, mapped so that a little overlap is best."""
    c = F.coalesce(c, F.lit(""))
    sets = F.transform(F.filter(_split_sentences(c), lambda s: F.length(s) > 5), topics)

    def neighbours(sets: Column) -> Column:
        n = F.size(sets)
        both = F.zip_with(F.slice(sets, 1, F.greatest(n - 1, F.lit(0))), F.slice(sets, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))
        return F.when(n < 2, 0.5).otherwise(let(F.filter(both, lambda x: x.isNotNull()), overlap))

    def overlap(real: Column) -> Column:
        return F.when(F.size(real) == 0, 0.3).otherwise(let(F.aggregate(real, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(real), F.lit(1)), shaped))

    def shaped(mean: Column) -> Column:
        return F.when(mean < 0.05, mean * 4).when(mean > 0.5, 0.7).otherwise(_cap(mean * 2 + 0.3))

    return let(sets, neighbours)


def structure_score(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    def score(n: Column) -> Column:
        mean = F.when(n > 0, F.length(c) / n).otherwise(0.0)
        count = F.when(n.between(3, 15), 0.4).when(n < 3, n * 0.1).otherwise(0.3)
        length = F.when(mean.between(20, 80), 0.3).when(mean < 20, mean / 20 * 0.2).otherwise(0.2)
        lines = F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""))
        return _cap(count + length + F.when(lines >= 2, 0.3).otherwise(0.15))

    return let(F.size(_split_sentences(c)), score)


def coherence(c: Column) -> Column:
    """Connectives, overlap of topics and structure; 0 below twenty characters."""
    c = F.coalesce(c, F.lit(""))
    score = connector_score(c) * 0.4 + topic_overlap(c) * 0.3 + structure_score(c) * 0.3
    return F.when(F.length(strip(c)) < 20, 0.0).otherwise(_cap(score))


def table_text_quality(c: Column) -> Column:
    """Quality of a table known by its text only."""
    c = F.coalesce(c, F.lit(""))
    score = (
        F.lit(0.5)
        + F.when((F.length(c) > 50) & (F.length(c) < 5000), 0.1).otherwise(0.0)
        + F.when(F.size(all_matches(c, r"[0-9]+\.?[0-9]*")) > 5, 0.15).otherwise(0.0)
        + F.least(F.lit(0.2), hits(c, lx.TABLE_KEYWORDS) * 0.05)
        + F.when(F.contains(c, F.lit("|")) | F.contains(c, F.lit("【表格内容】")), 0.1).otherwise(0.0)
    )
    return F.when(F.length(c) > 0, _cap(score)).otherwise(0.0)


def cells(rows: Column) -> Column:
    return F.flatten(F.filter(rows, lambda r: r.isNotNull()))


def contains_financial(rows: Column) -> Column:
    text = F.array_join(F.filter(cells(rows), lambda x: x.isNotNull() & (x != "")), " ")
    return has_any(text, (*lx.TABLE_KEYWORDS, *lx.HIGH_VALUE))


def table_quality(rows: Column) -> Column:
    """Quality of a table known by its cells: size, completeness, financial words and regular rows."""
    return let(rows, _rows_quality)


def _rows_quality(rows: Column) -> Column:
    n, m = F.size(rows), F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    full = F.size(F.filter(cells(rows), lambda x: x.isNotNull() & (strip(x) != "")))
    widths = F.array_distinct(F.transform(F.filter(rows, lambda r: F.size(r) > 0), F.size))
    score = (
        F.lit(0.7)
        + F.when(n.between(2, 50) & m.between(2, 15), 0.1).otherwise(0.0)
        + F.when(m > 0, full / (n * m) * 0.1).otherwise(0.0)
        + F.when(contains_financial(rows), 0.15).otherwise(0.0)
        + F.when(F.size(widths) == 1, 0.05).otherwise(0.0)
    )
    return F.when(F.coalesce(n, F.lit(0)) > 0, _cap(score)).otherwise(0.0)


def group_completeness(title: Column, note: Column, caption: Column) -> Column:
    return _cap(F.lit(0.5) + F.when(title.isNotNull(), 0.2).otherwise(0.0) + F.when(note.isNotNull(), 0.15).otherwise(0.0) + F.when(caption.isNotNull(), 0.15).otherwise(0.0))


def group_quality(completeness: Column, structure: Column, context: Column, table: Column) -> Column:
    return _cap(completeness * 0.3 + structure * 0.3 + context * 0.2 + table * 0.2)


def context_quality(*scores: Column) -> Column:
    """Mean of the scores that are there, 0.5 without any."""
    real = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(real) > 0, F.aggregate(real, F.lit(0.0), lambda s, x: s + x) / F.size(real)).otherwise(0.5)


_NUMBERED = ("^表\\s*[0-9一二三四五六七八九十]+", "^[0-9一二三四五六七八九十]+[.、\\s]", "^[（(][0-9一二三四五六七八九十]+[）)]", "^附表\\s*[0-9一二三四五六七八九十]+", "^图表\\s*[0-9一二三四五六七八九十]+")


def title_score(c: Column, distance: Column, page: Column, table_page: Column) -> Column:
    """How well an element ``distance`` places before a table serves as its title; 0 above a hundred characters."""
    bare = strip(c)
    n = F.length(bare)
    numbered = bare.rlike("|".join(_NUMBERED))
    score = F.when(n.between(5, 100), 0.2).otherwise(0.0) + F.when(has_any(bare, lx.TITLE_WORDS), 0.3).otherwise(0.0) + F.when(numbered, 0.4).otherwise(0.0)
    near = score * F.greatest(F.lit(0.0), F.lit(1.0) - (distance - 1) * 0.2)
    place = F.when(page == table_page, 0.1).when(page < table_page, 0.05).otherwise(0.0)
    return F.when(n > 100, 0.0).otherwise(_cap(near + place))


def recommendation(score: Column) -> Column:
    return F.when(score < 0.6, "质量较低，建议重新提取或手动校验").when(score < 0.8, "质量中等，可能需要部分校验").otherwise("质量良好，可直接使用")


def relevance(c: Column, typed: Column, financial: Column) -> Column:
    """1 for a typed table, 0.8 for one with financial words, else a fifth for each of six words."""
    return F.when(typed, 1.0).when(financial, 0.8).otherwise(_cap(F.size(words_in(c, "股东 现金 利润 收入 负债 资产".split())) * 0.2))
