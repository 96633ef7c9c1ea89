"""Titles, notes and captions of tables among the elements around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings, lexicons, scores
from ..functions.text import has_any, strip
from .folds import assign_context


def described(elements: DataFrame) -> DataFrame:
    """Elements with what the choice of context looks at, computed before any fold. Words are looked for once: no blanks are in them, so stripping is no matter."""
    c = F.col("content")
    base = elements.withColumns({"_bare": strip(c), "_unit": has_any(c, lexicons.UNIT_WORDS), "_word": has_any(c, lexicons.TITLE_WORDS)})
    bare, unit, word = F.col("_bare"), F.col("_unit"), F.col("_word")
    own = F.when(F.length(bare).between(5, 100), 0.2).otherwise(0.0) + F.when(word, 0.3).otherwise(0.0) + F.when(bare.rlike("|".join(scores._NUMBERED)), 0.4).otherwise(0.0)
    return base.withColumns(
        {
            "kind": F.when(bare.rlike(headings.TITLE_FORMS), "pattern").when(unit, "unit").when(word, "keyword"),
            "second_kind": F.when(unit, "unit").when(word, "keyword"),
            "numbered_score": own,
            "is_note": headings.is_note(c, F.col("element_type")),
            "is_caption": headings.is_caption(c, F.col("element_type"), unit),
        }
    ).drop("_bare", "_unit", "_word")


def contexts(elements: DataFrame, before: int = 10, after: int = 3) -> DataFrame:
    """Context of every table with each element used once, in document order; see :func:`.folds.assign_context`.

    Only elements that a table looks at, and tables, are described and folded.
    """
    w = Window.partitionBy("doc_id").orderBy("seq", "element_type", "content", "page_number")
    table = F.coalesce(F.col("element_type") == "table", F.lit(False))
    seen = table
    for low, high in ((1, before), (-max(after, 1), -1)):
        if high >= low:
            seen = seen | F.coalesce(F.max(table).over(w.rowsBetween(low, high)), F.lit(False))
    # a caption may stand right before a table even where no title is looked for
    seen = seen | F.coalesce(F.lead(table).over(w), F.lit(False))
    e = elements.withColumns({"pos": F.row_number().over(w) - 1, "_seen": seen}).where("_seen").drop("_seen")
    return assign_context(described(e), before, after)


def title_candidates(elements: DataFrame, before: int = 10) -> DataFrame:
    """``(doc_id, table_seq, title_seq, score)``: each table's best title among the elements before it, with no regard to other tables.

    The window is a range over ``seq``, which counts elements without gaps: a table looks back by ``before`` shifted copies, not by a join over pairs.
    """
    e = described(elements)
    # an element's own score needs no table: the window carries it, not the contents
    fits = (F.col("element_type") != "table") & F.col("kind").isNotNull()
    e = e.withColumn("_own", F.when(fits, F.struct("seq", "page_number", "kind", F.col("numbered_score").alias("score"), (F.length(strip(F.col("content"))) <= 100).alias("short"))))
    back = F.collect_list("_own").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(-before, -1))
    t = e.select("doc_id", "seq", "page_number", "element_type", back.alias("_back")).where("element_type = 'table'").select("doc_id", F.col("seq").alias("table_seq"), F.col("page_number").alias("_page"), F.explode("_back").alias("c"))
    near = F.col("c.score") * F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("table_seq") - F.col("c.seq") - 1) * 0.2)
    place = F.when(F.col("c.page_number") == F.col("_page"), 0.1).when(F.col("c.page_number") < F.col("_page"), 0.05).otherwise(0.0)
    base = F.when(F.col("c.short"), F.least(F.lit(1.0), near + place)).otherwise(0.0)
    weight = F.when(F.col("c.kind") == "pattern", 1.0).when(F.col("c.kind") == "unit", 0.8).otherwise(0.7)
    ranked = t.select("doc_id", "table_seq", F.col("c.seq").alias("title_seq"), F.col("c.kind").alias("kind"), (base * weight).alias("score"))
    best = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "table_seq").orderBy(F.desc("score"), "title_seq"))).where("_r = 1 and kind = 'pattern' and score >= 0.5")
    return best.select("doc_id", "table_seq", "title_seq", "score")


def notes(elements: DataFrame, after: int = 3) -> DataFrame:
    """``(doc_id, table_seq, note_seq)``: the first note among the elements after each table."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, after)
    seq = F.when(headings.is_note(F.col("content"), F.col("element_type")), F.col("seq"))
    return elements.withColumn("note_seq", F.min(seq).over(w)).where("element_type = 'table' and note_seq is not null").select("doc_id", F.col("seq").alias("table_seq"), "note_seq")


def captions(elements: DataFrame) -> DataFrame:
    """``(doc_id, table_seq, caption_seq)``: the element before each table if it is a caption, else the one after."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    seq = F.when(headings.is_caption(F.col("content"), F.col("element_type")), F.col("seq"))
    found = elements.withColumn("_own", seq)
    found = found.withColumn("caption_seq", F.coalesce(F.lag("_own").over(w), F.lead("_own").over(w)))
    return found.where("element_type = 'table' and caption_seq is not null").select("doc_id", F.col("seq").alias("table_seq"), "caption_seq")


def unused(elements: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """Elements that no group's ``columns`` (``table_seq``, ``title_seq``, ...) name."""
    taken = groups.select("doc_id", F.explode(F.array(*columns)).alias("seq")).where("seq is not null")
    return elements.join(taken, ["doc_id", "seq"], "left_anti")


def separated_headers(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """``(doc_id, group_no, header_seqs)``: header lines among the three elements before place ``group_no`` of the document.

    The place is the group's number, not its table's, which parity asks for.
    """
    e = elements.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).where((F.col("element_type") != "table") & headings.is_header(F.col("content")))
    spread = e.select("doc_id", "seq", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 3)).alias("group_no"))
    return tables.select("doc_id", "group_no").join(spread, ["doc_id", "group_no"]).groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list("seq")).alias("header_seqs"))


def overlaps(a: Column, b: Column) -> Column:
    """Boxes that share a point; touching counts."""
    return ~((a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"]))


def outside_tables(texts: DataFrame, tables: DataFrame, key: str = "page_id") -> DataFrame:
    """Texts whose box touches no table of their page; texts without a box stay. An equi-join on the page carries the range test."""
    t = tables.select(F.col(key).alias("_k"), F.struct("x0", "y0", "x1", "y1").alias("_box"))
    box = F.struct("x0", "y0", "x1", "y1")
    return texts.join(t, (F.col(key) == F.col("_k")) & overlaps(box, F.col("_box")), "left_anti")


def envelope(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def estimated_box(content: Column, parity: bool = True) -> Column:
    """A centred box on an A4 page for text without one: twenty points a line that is not blank, eight a character of the longest.

    Without any such line, ``parity`` takes fifty characters for blank text and the middle of the page for an empty one; else the box is as wide as
    boxes get and has no height.
    """
    lines = F.filter(F.split(content, "\n"), lambda x: strip(x) != "")
    height = F.least(F.lit(600.0), F.size(lines) * 20.0)
    longest = F.array_max(F.transform(lines, F.length)) * 8.0
    width = F.least(F.lit(500.0), F.coalesce(longest, F.lit(400.0)) if parity else longest)
    x0 = (F.lit(595.0) - width) / 2
    guess = F.struct(x0.alias("x0"), F.lit(80.0).alias("y0"), (x0 + width).alias("x1"), (F.lit(80.0) + height).alias("y1"))
    page = F.struct(F.lit(50.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(545.0).alias("x1"), F.lit(742.0).alias("y1"))
    return F.when(F.length(F.coalesce(content, F.lit(""))) > 0, guess).otherwise(page) if parity else guess


def pixels_to_points(box: Column, dpi: int = 150, pad: float = 0.02) -> Column:
    """A detector's box, widened by ``pad`` of its size, in points."""
    dx, dy = (box["x1"] - box["x0"]) * pad, (box["y1"] - box["y0"]) * pad
    s = 72.0 / dpi
    return F.struct(((box["x0"] - dx) * s).alias("x0"), ((box["y0"] - dy) * s).alias("y0"), ((box["x1"] + dx) * s).alias("x1"), ((box["y1"] + dy) * s).alias("y1"))
