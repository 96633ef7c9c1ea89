"""Operators over tables: parsing, rendering, cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, rstrip, strip

_RULE = r"^[-\s|:]+$"
_HEADER_WORDS = "注|小计|合计|金额|日期|期间|指标|科目|项目|币种|单位"


def clean_cells(rows: Column) -> Column:
    """Rows without such as are empty throughout; nulls become '', blanks inside cells collapse."""
    one = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda x: strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))))
    return F.filter(one, lambda r: F.exists(r, lambda x: x != ""))


def rows_to_text(rows: Column) -> Column:
    """Cells joined by pipes, with a line of fifty hyphens below the first row; empty later rows are skipped."""
    return let(rows, _rows_to_text)


def _rows_to_text(rows: Column) -> Column:
    line = lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | ")
    head = F.get(rows, F.lit(0))
    top = F.when(F.size(head) > 0, F.array(line(head), F.lit("-" * 50))).otherwise(F.array().cast("array<string>"))
    rest = F.transform(F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) > 0), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(top, rest), "\n")).otherwise("")


def rows_to_markdown(rows: Column) -> Column:
    """A Markdown table below the line that marks a table's content."""
    return let(rows, _rows_to_markdown)


def _rows_to_markdown(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda x: F.lit("---")), " | "), F.lit(" |"))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.lit("【表格内容】"), line(head), rule), rest), "\n")).otherwise("")


def parse_rows(c: Column) -> Column:
    """Rows of cells from lines that have pipes, tabs or wide blanks; other lines and rules are left out."""

    def cells(line: Column) -> Column:
        pipes = F.transform(F.split(line, r"\|"), strip)
        lead = F.when(F.get(pipes, F.lit(0)) == "", F.slice(pipes, 2, F.greatest(F.size(pipes) - 1, F.lit(0)))).otherwise(pipes)
        trimmed = F.when((F.size(lead) > 0) & (F.try_element_at(lead, F.lit(-1)) == ""), F.slice(lead, 1, F.greatest(F.size(lead) - 1, F.lit(0)))).otherwise(lead)
        return F.when(F.contains(line, F.lit("|")), trimmed).when(F.contains(line, F.lit("\t")), F.transform(F.split(line, "\t"), strip)).otherwise(F.transform(F.split(line, r"\s{2,}"), strip))

    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x.rlike(r"[|\t]|\s{2,}"))
    return F.filter(F.transform(lines, cells), lambda r: F.exists(r, lambda x: ~x.rlike("^-*$")))


def detect_header(rows: Column) -> Column:
    """Text in more than half of the first row and figures in more than three tenths of the second."""
    return let(rows, _detect_header)


def _detect_header(rows: Column) -> Column:
    first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    figure = "^[0-9.,%-]+$"
    text = F.size(F.filter(first, lambda x: x.isNotNull() & (x != "") & ~x.rlike(figure)))
    number = F.size(F.filter(second, lambda x: x.isNotNull() & x.rlike(figure)))
    return F.coalesce((F.size(rows) >= 2) & (text > F.size(first) * 0.5) & (number > F.size(second) * 0.3), F.lit(False))


def clean_markdown(c: Column) -> Column:
    """Lines with pipes: runs of three and more pipes become one, and those that end a line one with a blank before."""
    line = lambda x: F.when(F.contains(x, F.lit("|")), F.regexp_replace(F.regexp_replace(x, r"(\|\s*){3,}", "| "), r"(\|\s*)+\|$", " |")).otherwise(x)
    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def _squeeze(row: Column) -> Column:
    """One empty cell for each run of such, unless all are empty."""
    kept = F.filter(F.transform(row, lambda x, i: F.when((x != "") | (i == 0) | (F.get(row, i - 1) != ""), x)), lambda x: x.isNotNull())
    return F.when(F.exists(row, lambda x: x != ""), kept).otherwise(row)


def to_markdown(c: Column) -> Column:
    """Table lines as Markdown: rows padded to the widest, a rule below the first; text that has a rule is only cleaned, and text without rows stays."""

    def cells(line: Column) -> Column:
        piped = F.transform(F.split(F.regexp_replace(line, r"^[|\s]+|[|\s]+$", ""), r"\|"), strip)
        return F.when(F.contains(line, F.lit("|")), _squeeze(piped)).when(F.contains(line, F.lit("\t")), F.transform(F.split(line, "\t"), strip)).otherwise(F.transform(F.split(line, r"\s{2,}"), strip))

    lines = F.transform(F.split(c, "\n"), strip)
    rule = lambda x: x.rlike(_RULE) & F.contains(x, F.lit("---"))
    rows = F.transform(F.filter(lines, lambda x: ~rule(x) & x.rlike(r"\t|\s{2,}|[^|\s].*\||\|.*[^|\s]")), cells)
    return let(rows, lambda r: F.when(F.size(r) == 0, c).when(F.exists(lines, rule), clean_markdown(c)).otherwise(let(F.array_max(F.transform(r, F.size)), lambda widest: _markdown_of(r, widest))))


def _markdown_of(rows: Column, widest: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))), " | "), F.lit(" |"))
    below = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), widest), "|"), F.lit("|"))
    return F.array_join(F.concat(F.transform(F.slice(rows, 1, 1), line), F.array(below), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def is_table_line(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit("|"))) >= 2) | (line.rlike(_RULE) & F.contains(line, F.lit("---")))


def separate(c: Column) -> Column:
    """struct(text, table) of the stripped lines that are not blank: table lines, and short ones without a sentence's end once the table has begun, are the table."""
    return let(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), _separate)


def _separate(lines: Column) -> Column:
    begun = F.array_position(F.transform(lines, is_table_line), F.lit(True))
    flags = let(begun, lambda begun: F.transform(lines, lambda x, i: is_table_line(x) | ((begun > 0) & (i >= begun) & (F.length(x) < 50) & ~x.rlike("[。！？]"))))
    pick = lambda flags, want: F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(F.get(flags, i) == want, x)), lambda x: x.isNotNull()), "\n")
    return let(flags, lambda f: F.struct(pick(f, False).alias("text"), pick(f, True).alias("table")))


def clean_special(c: Column) -> Column:
    """Without stars around the whole, page numbers glued to stars, and stars that end lines."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)^\*(.+?)\*$", "$1"), r"^\*|\*$", "")
    out = F.regexp_replace(out, r"[0-9]+。\*\s*(\n|$)", "$1")
    return strip(F.regexp_replace(out, r"(?m)[ \t]*\*[ \t]*$", ""))


def format_content(c: Column) -> Column:
    """Text lines, then the table lines as Markdown, two parts joined by a blank line."""
    parts = separate(clean_special(c))
    filled = lambda x: F.when(x != "", x)
    out = F.concat_ws("\n\n", filled(strip(parts["text"])), filled(to_markdown(parts["table"])))
    return F.when(out != "", out).otherwise(c)


def trim_noise(c: Column) -> Column:
    """Without the lines before the first and after the last that belongs to a table, where they are three or more; blank lines end such a run."""
    tableish = lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t")) | (F.size(F.split(strip(x), r"\s{2,}")) >= 3) | x.rlike(_HEADER_WORDS)
    return let(F.transform(F.split(c, "\n"), rstrip), lambda lines: let(F.transform(lines, lambda x: (strip(x) == "") | tableish(x)), lambda stops: _trimmed(c, lines, stops)))


def _trimmed(c: Column, lines: Column, stops: Column) -> Column:
    n = F.size(lines)
    head = F.when(F.array_contains(stops, True), F.array_position(stops, F.lit(True)).cast("int") - 1).otherwise(n)
    head = F.when(head >= 3, head).otherwise(0)
    tail = F.when(F.array_contains(stops, True), F.array_position(F.reverse(stops), F.lit(True)).cast("int") - 1).otherwise(0)
    tail = F.when(tail >= 3, tail).otherwise(0)
    kept = F.slice(lines, head + 1, F.greatest(n - head - tail, F.lit(0)))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(c)


def clean_table(c: Column) -> Column:
    """Table text without running heads, page numbers, stray stars and characters that no table has, and without noise around it."""
    out = F.regexp_replace(c, r"(?m)^\*?[^\n]{0,80}年度报告全文\s*", "")
    for p in (r"(?m)^[0-9]+\s*$", r"(?m)^[0-9]+\s*[/／]\s*[0-9]+\s*$", r"(?m)^第\s*[0-9]+\s*页\s*$", r"(?m)^共\s*[0-9]+\s*页\s*$"):
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(out, r"(?m)^\*(?=[一-鿿□√（0-9-])", "")
    out = F.regexp_replace(out, r"[^一-鿿 -~\n\r\t，。！？；：（）【】]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " +", " "), r"\n{3,}", "\n\n")
    return strip(trim_noise(out))


def clean_markers(c: Column) -> Column:
    """Without page numbers glued to stars and single stars at ends of lines; pairs of stars stay."""
    out = F.regexp_replace(c, r"[0-9]+[。.]\*\s*", "")
    out = F.regexp_replace(out, r"(?m)^\*(?!\*)", "")
    return strip(F.regexp_replace(out, r"(?m)(?<!\*)\*[ \t]*$", ""))


def dimensions(c: Column) -> Column:
    """struct(n_rows, n_cols) estimated from text; marked lines and rules do not count."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (x != "") & ~(F.startswith(x, F.lit("【")) & F.contains(F.left(x, F.lit(10)), F.lit("】"))) & ~x.rlike(_RULE))
    width = lambda x: F.when(F.contains(x, F.lit("|")), F.size(F.filter(F.split(x, r"\|"), lambda y: strip(y) != ""))).when(F.contains(x, F.lit("\t")), F.size(F.split(x, "\t"))).when(x.rlike(r"\s{2,}"), F.size(F.split(x, r"\s{2,}"))).otherwise(0)
    return F.struct(F.size(lines).alias("n_rows"), F.coalesce(F.array_max(F.transform(lines, width)), F.lit(0)).alias("n_cols"))


def unify(title: Column, caption: Column, header: Column, body: Column, note: Column) -> Column:
    """The parts of a table group under their marks, joined by blank lines; null parts are left out, the body is cleaned."""
    part = lambda mark, c: F.concat(F.lit(f"【{mark}】"), strip(c))
    return F.concat_ws("\n\n", part("标题", title), part("说明", caption), part("表头", header), F.concat(F.lit("【表格内容】\n"), clean_table(body)), part("注释", note))


def group_markdown(title: Column, caption: Column, header: Column, body: Column, note: Column) -> Column:
    part = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    return F.concat_ws("\n", part("### ", title, "\n"), part("*", caption, "*\n"), part("**表头:** ", header, "\n"), body, part("\n> 注：", note, ""))


def annotate_lines(lines: Column, paths: Column, most: int = 50, indent: bool = False) -> Column:
    """Each line below its row's path, in brackets unless ``indent``; line i takes path i, as far as there are paths."""
    path = lambda i: F.left(F.coalesce(F.get(paths, i), F.lit("")), F.lit(most))
    before, after = ("", "\n") if indent else ("【", "】\n")
    return F.transform(lines, lambda x, i: F.when(path(i) != "", F.concat(F.lit(before), path(i), F.lit(after), x)).otherwise(x))


def split_by_items(lines: DataFrame, items: DataFrame, key: str = "table_id") -> DataFrame:
    """``lines(key, line_no, line)`` with ``part_no``: a part begins where the first listed item in a line differs from the last one found.

    ``items(key, items)`` lists a table's items; tables without any are one part.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    found = lines.join(items, key, "left").withColumn("item", F.get(F.filter("items", lambda x: F.contains("line", x)), F.lit(0)))
    new = found.withColumn("_was", F.last("item", ignorenulls=True).over(before)).withColumn("_new", (F.col("item").isNotNull() & (F.col("_was").isNull() | (F.col("item") != F.col("_was"))) & (F.col("line_no") > F.min("line_no").over(w))).cast("int"))
    return new.withColumn("part_no", F.sum("_new").over(w)).select(key, "line_no", "part_no", "item", "line")


def split_by_periods(lines: DataFrame, periods: int, key: str = "table_id") -> DataFrame:
    """Lines in ``periods`` even parts, of which the last takes what is left over."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    each = F.greatest(F.lit(1), F.floor(n / periods))
    return lines.withColumn("part_no", F.least(F.floor((F.row_number().over(w.orderBy("line_no")) - 1) / each), F.lit(periods - 1)).cast("int"))
