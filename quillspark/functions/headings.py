"""Kinds of elements and levels of headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import all_matches, has_any, occurrences, strip

_N = "[一二三四五六七八九十]"
_TABLE_TITLES = f"(表|表格|附表|图表)\\s*[0-9一二三四五六七八九十]+|Table\\s*[0-9]+"
_HEADINGS = (f"^第[一二三四五六七八九十0-9]+[章节部分]", f"^{_N}+[、.]\\s*\\S+", f"^[（(]{_N}+[)）]\\s*\\S+", r"^[0-9]+[、.．]\s*\S+", r"^[0-9]+\.?[0-9]*\.?\s*\S+")
#: A page or running number before the text proper.
RUNNING = "^\\s*[0-9]{1,4}\\s*(?:[、.．]\\s*)?"
_BULLET = "[•·▪▫◦‣⁃]"


def without_number(c: Column) -> Column:
    """The text without a leading page or running number."""
    return F.regexp_replace(c, RUNNING, "")


def valid_table(c: Column) -> Column:
    """Two lines or more that have nearly as many tabs or pipes each, or a pair of figures anywhere."""
    lines = F.filter(F.split(strip(c), "\n"), lambda x: strip(x) != "")
    counts = lambda mark: F.transform(lines, lambda x: occurrences(x, F.lit(mark)))
    tabs, pipes = counts("\t"), counts("|")
    even = lambda n, least: (F.array_min(n) > least) & (F.array_max(n) - F.array_min(n) <= 2)
    return (F.size(lines) >= 2) & (even(tabs, 0) | even(pipes, 1) | c.rlike(r"[0-9][0-9,.]+\s+[0-9][0-9,.]+"))


def element_type(c: Column, declared: Column | None = None) -> Column:
    """title, table, list or text; ``declared`` is the reader's own category."""
    bare = without_number(c)
    title = F.lit(False)
    for p in _HEADINGS:
        title = title | bare.rlike(p)
    marked = (occurrences(c, F.lit("\t")) > 3) | (occurrences(c, F.lit("|")) > 3)
    if declared is not None:
        marked = marked | F.coalesce(declared == "Table", F.lit(False))
    return (
        F.when((F.length(c) < 100) & (c.rlike(_TABLE_TITLES) | title), "title")
        .when(marked & valid_table(c), "table")
        .when(c.rlike(f"^([(（][0-9]+[)）]|{_BULLET})"), "list")
        .otherwise("text")
    )


_LEVELS = ("^(第[一二三四五六七八九十0-9]+[章节部分])\\s*(.*)", f"^({_N}+[、.])\\s*(.*)", f"^([（(]{_N}+[)）])\\s*(.*)", r"^([0-9]+[、.．])\s*(.*)")


def first_line(c: Column) -> Column:
    return strip(F.substring_index(strip(c), "\n", 1))


def heading_level(c: Column) -> Column:
    """1 to 4 by the first line's numbering, else null; a figure numbers a heading only where the rest does not read like a sentence."""
    line = first_line(c)
    rest = strip(F.regexp_extract(line, _LEVELS[3], 2))
    sentence = (F.length(rest) > 50) | rest.rlike("^[0-9]{4}年") | rest.rlike("[。！？]$") | (F.contains(rest, F.lit("，")) & (F.length(rest) > 30))
    return F.when(line.rlike(_LEVELS[0]), 1).when(line.rlike(_LEVELS[1]), 2).when(line.rlike(_LEVELS[2]), 3).when(line.rlike(_LEVELS[3]) & ~sentence, 4)


def heading_title(c: Column) -> Column:
    """Number and text of the heading, or null."""
    line, level = first_line(c), heading_level(c)
    out = None
    for k, p in enumerate(_LEVELS, 1):
        title = strip(F.concat(F.regexp_extract(line, p, 1), F.lit(" "), F.regexp_extract(line, p, 2)))
        out = F.when(level == k, title) if out is None else out.when(level == k, title)
    return out


def looks_like_heading(c: Column) -> Column:
    """A chapter heading without any column separator, taken for a table."""
    return without_number(first_line(c)).rlike(_HEADINGS[0]) & ~c.rlike(r"[\t|]")


_ROW_LEVELS = ((f"^{_N}+、", 1), (f"^[（(]{_N}+[)）]", 2), (r"^[0-9]+[、.．]", 3))


def row_level(cell: Column) -> Column:
    """Level of a table row by its indent and numbering."""
    bare = F.ltrim(cell, F.lit(" \t　"))
    indent = F.floor((F.length(cell) - F.length(bare)) / 2).cast("int")
    level = indent
    for p, k in _ROW_LEVELS:
        level = F.greatest(level, F.when(bare.rlike(p), k).otherwise(0))
    return F.when(bare.rlike("^[-•·└├─]"), F.greatest(level, indent + 1)).otherwise(level)


def row_name(cell: Column) -> Column:
    """A row's name without indent, number and bullet."""
    bare = F.ltrim(cell, F.lit(" \t　"))
    bare = F.when(bare.rlike("^[-•·└├─]"), strip(F.substring(bare, 2, 2**31 - 1))).otherwise(bare)
    for p, _ in _ROW_LEVELS:
        bare = F.regexp_replace(bare, p, "")
    return strip(F.ltrim(bare, F.lit("-•·└├─")))


_HEADER_FORMS = ("第[一二三四]季度", "[0-9]{4}年[0-9]{1,2}月", "[0-9]{4}年度?", "[一二三四五六七八九十0-9]+[-\\s]?[一二三四五六七八九十0-9]+月份?", "（[1-4]-[36912]月份?）", "项目", "科目")


def has_header(c: Column) -> Column:
    """One of the first three lines reads like column names."""
    return F.array_join(F.slice(F.split(c, "\n"), 1, 3), "\n").rlike("|".join(_HEADER_FORMS))


def is_header(c: Column) -> Column:
    """An element that is a table's header line: column words, separators and brackets add up to a half."""
    bare = strip(c)
    separated = F.contains(bare, F.lit("|")) | F.contains(bare, F.lit("\t")) | F.contains(bare, F.lit("    "))
    count = F.lit(0)
    for p in _HEADER_FORMS:
        count = count + bare.rlike(p).cast("int")
    tenths = F.when(count >= 2, 5).when(count == 1, 3).otherwise(0) + F.when(separated, 3).otherwise(0) + F.when(bare.rlike("[（(]"), 2).otherwise(0)
    return F.length(bare).between(5, 300) & ~bare.rlike("[。！？!?]$") & ~((F.length(bare) > 50) & ~separated) & (tenths >= 5)


def is_note(c: Column, kind: Column) -> Column:
    return (kind != "table") & (F.length(c) <= 500) & has_any(c, lx.NOTE_WORDS)


def is_caption(c: Column, kind: Column, unit: Column | None = None) -> Column:
    """``unit`` tells whether a word of units is in the text, where that is known."""
    short = (F.length(c) > 20) & (F.length(c) < 100) & c.rlike("[(（]")
    return (kind != "table") & ((has_any(c, lx.UNIT_WORDS) if unit is None else unit) | short)


#: What a table's title may look like.
TITLE_FORMS = "|".join(
    (
        "^(表|附表|图表)\\s*[0-9一二三四五六七八九十]+[-：:]?\\s*.+",
        "^[(（][0-9一二三四五六七八九十]+[)）]\\s*.+",
        "^[0-9一二三四五六七八九十]+[.、]\\s*.+",
        "^第?[一二三四五六七八九十]+[节章部分]\\s*.+",
    )
)


def title_kind(c: Column) -> Column:
    """pattern, unit or keyword: what makes an element a candidate for a title, or null."""
    bare = strip(c)
    return F.when(bare.rlike(TITLE_FORMS), "pattern").when(has_any(bare, lx.UNIT_WORDS), "unit").when(has_any(bare, lx.TITLE_WORDS), "keyword")


def years(c: Column) -> Column:
    return all_matches(c, "([0-9]{4})年", 1)
