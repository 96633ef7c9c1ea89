"""From elements to chunks: the whole chain that the single operators make up.

Everything is keyed by ``doc_id``. One shuffle by document feeds the context fold and one the grouping; all other steps are expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, headings, lexicons, scores, text
from ..operators import chunks, context, elements, enrich, folds, tables, windows
from ..staging import stage


@dataclass(frozen=True)
class Options:
    """Sizes of parents and children, and what a chunk must have to stay."""

    parent_size: int = 4000
    child_size: int = 1200
    overlap: int = 200
    least_size: int = 50
    least_quality: float = 0.3
    before: int = 10
    after: int = 3
    #: How text becomes parents: ``semantic`` groups of elements, ``sliding`` windows, or anything else for pieces of fixed size.
    strategy: str = "semantic"

    @classmethod
    def of(cls, config: dict, section: str = "chunking") -> Options:
        """Options from nested settings: the section's values over those of the top level; unknown names are ignored."""
        merged = {**config, **(config.get(section) or {})}
        return cls(**{k: merged[k] for k in cls.__dataclass_fields__ if k in merged})


def prepare(raw: DataFrame) -> DataFrame:
    """Elements ``(doc_id, seq, page_number, content)`` cleaned, merged, typed, annotated and without page marks, in the order in which each step needs the last."""
    clean = elements.drop_noise(elements.typed(raw))
    merged = folds.merge_paragraphs(clean)
    noted = elements.annotate(merged)
    return noted.withColumn("content", text.strip_page_markers(F.col("content")))


def table_groups(prepared: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each table with its context, separated header, unified content, Markdown, type, items, periods, unit and scores."""
    found = context.contexts(prepared, options.before, options.after)
    found = found.withColumn("group_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq")) - 1)
    e = prepared.select("doc_id", "seq", "content")
    heads = context.separated_headers(prepared, found).select("doc_id", "group_no", F.explode("header_seqs").alias("seq")).join(e, ["doc_id", "seq"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: text.strip(x["content"]))
    heads = heads.groupBy("doc_id", "group_no").agg(F.array_join(lines, "\n").alias("header"))
    part = lambda name: e.select("doc_id", F.col("seq").alias(f"{name}_seq"), F.col("content").alias(name))
    tabled = prepared.select("doc_id", F.col("seq").alias("table_seq"), F.col("content").alias("table"), F.col("pages").alias("page_numbers"))
    out = found.join(tabled, ["doc_id", "table_seq"]).join(part("note"), ["doc_id", "note_seq"], "left").join(part("caption"), ["doc_id", "caption_seq"], "left").join(heads, ["doc_id", "group_no"], "left")
    out = out.withColumnRenamed("title_text", "title")
    t, c, b, n, h = F.col("title"), F.col("caption"), F.col("table"), F.col("note"), F.col("header")
    quality = scores.table_text_quality(b)
    complete = scores.group_completeness(t, n, c)
    around = scores.context_quality(*(F.when(x.isNotNull(), scores.element_quality(x)) for x in (t, n, c)))
    return out.withColumns(
        {
            "unified": tables.unify(t, c, h, b, n),
            "markdown": tables.group_markdown(t, c, h, b, n),
            "table_type": extract.statement_type(t, b),
            "accounting_items": extract.clean_items(extract.accounting_items(b)),
            "time_periods": extract.time_periods(t, c, F.left(b, F.lit(500))),
            "monetary_unit": extract.monetary_unit(c, t, b),
            "dimensions": tables.dimensions(b),
            "quality": scores.group_quality(complete, F.lit(1.0), around, quality),
        }
    )


def _members(rest: DataFrame, groups: DataFrame, *names: str) -> DataFrame:
    """Elements with the group that the last beginning of one before them names; groups are runs of elements of a section."""
    mark = groups.select("doc_id", "section", F.col("first_seq").alias("seq"), F.struct(*names).alias("_g"))
    w = Window.partitionBy("doc_id", "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rest.join(mark, ["doc_id", "section", "seq"], "left").withColumn("_g", F.last("_g", ignorenulls=True).over(w))
    return out.select(*rest.columns, *(F.col(f"_g.{n}").alias(n) for n in names))


def semantic_parents(rest: DataFrame, parent_size: int) -> DataFrame:
    """Groups by meaning; a group whose joined text is too large is split again, with its separators counted. With pages and mean quality of the elements."""
    grouped = folds.semantic_groups(rest, parent_size, ("doc_id", "section"))
    large = F.length("content") > parent_size
    inside = _members(rest, grouped, "group_no")
    again = inside.join(grouped.where(large).select("doc_id", "section", "group_no"), ["doc_id", "section", "group_no"], "left_semi")
    parts = folds.split_large_groups(again, parent_size, ("doc_id", "section", "group_no"), joined=True)
    units = grouped.where(~large).withColumn("part_no", F.lit(0)).unionByName(parts)
    facts = _members(rest, units, "group_no", "part_no").groupBy("doc_id", "section", "group_no", "part_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("page_numbers"), F.avg(scores.element_quality(F.col("content"))).alias("confidence"))
    return units.join(facts, ["doc_id", "section", "group_no", "part_no"])


def plain_parents(rest: DataFrame, options: Options) -> DataFrame:
    """Windows or pieces of fixed size of a document's whole text, whatever its sections."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n\n")
    whole = rest.groupBy("doc_id").agg(joined.alias("body"), F.min("seq").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("page_numbers"), F.avg(scores.element_quality(F.col("content"))).alias("confidence"))
    if options.strategy == "sliding":
        cut = windows.parent_windows(whole, "body", options.parent_size, options.overlap).drop("start_char", "end_char")
    else:
        size = options.parent_size
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("body") / size).cast("int") - 1)), lambda k: F.substring(F.col("body"), k * size + 1, F.lit(size)))
        cut = whole.select("doc_id", "first", "page_numbers", "confidence", F.posexplode(pieces).alias("position", "content"))
    return cut.withColumns({"section": F.lit(lexicons.NO_SECTION), "group_no": F.col("position"), "part_no": F.lit(0), "first_seq": F.col("first") + F.col("position")}).drop("position", "first")


def text_parents(prepared: DataFrame, groups: DataFrame, options: Options = Options()) -> DataFrame:
    """Parent chunks of text: elements that are no table, by the strategy of the options."""
    rest = elements.carry_section(context.unused(prepared, groups, "table_seq")).withColumn("content", F.coalesce("content", F.lit("")))
    made = semantic_parents(rest, options.parent_size) if options.strategy == "semantic" else plain_parents(rest, options)
    c = F.col("content")
    fields = {
        "chunk_type": F.lit("text"),
        "content": tables.clean_markers(c),
        "quality": scores.content_quality(c),
        "indicators": extract.financial_indicators(c),
        "keywords": extract.keywords(c),
        "chunk_id": text.short_id(F.col("doc_id").cast("string"), F.lit("text"), F.col("section"), F.col("group_no").cast("string"), F.col("part_no").cast("string")),
    }
    return made.withColumns(fields)


def table_parents(groups: DataFrame) -> DataFrame:
    """Parent chunks of tables; such as read like headings count as text."""
    body = tables.clean_markers(F.col("unified"))
    important = F.col("table_type").isin(*lexicons.IMPORTANT_TYPES)
    return groups.select(
        "doc_id",
        F.col("table_seq").alias("first_seq"),
        F.when(headings.looks_like_heading(F.col("table")), "text").otherwise("table_group").alias("chunk_type"),
        body.alias("content"),
        "quality",
        important.alias("important"),
        F.when(important, F.col("accounting_items")).alias("items"),
        F.when(important, F.col("time_periods")).alias("periods"),
        "page_numbers",
        scores.element_quality(F.col("table")).alias("confidence"),
        extract.financial_indicators(body).alias("indicators"),
        extract.keywords(body).alias("keywords"),
        text.short_id(F.col("doc_id").cast("string"), F.lit("table"), F.col("table_seq").cast("string")).alias("chunk_id"),
    )


def section_nodes(parents: DataFrame) -> DataFrame:
    """A node ``(doc_id, chunk_id, chunk_type, seq, section_level, section_title, section_path, parent_section_seq, content)`` for every heading among parents of :func:`.elements.section_tree`."""
    node = text.short_id(F.col("doc_id").cast("string"), F.lit("section"), F.col("seq").cast("string"))
    own = parents.where("heading_level is not null")
    return own.select("doc_id", node.alias("chunk_id"), F.lit("section").alias("chunk_type"), "seq", "section_level", "section_title", "section_path", "parent_section_seq", F.col("section_title").alias("content"))


def table_children(parents: DataFrame, options: Options) -> DataFrame:
    """Children of table parents ``(doc_id, chunk_id, position, content)``: by items, else by periods where the table is important, else by size; a small table is one child."""
    # short ids repeat among documents
    own = parents.where("chunk_type = 'table_group'").withColumn("table_id", F.concat_ws("|", F.col("doc_id").cast("string"), "chunk_id"))
    lines = own.select("table_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    found = enrich.split_table(lines, own.select("table_id", "items", "periods"), options.child_size)
    return found.join(own.select("table_id", "doc_id", "chunk_id"), "table_id").select("doc_id", "chunk_id", F.col("part_no").alias("position"), "content")


def chunk_documents(raw: DataFrame, options: Options = Options(), names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children, table groups) of raw elements.

    Parents carry their section, pages and mean quality of elements; tables come first in emission order, important ones before others, so that they
    normally have no section. Every heading among them also gives a node of type ``section``. Children of text are windows of their parents' contents, those
    of tables parts by items, periods or size; they inherit sections and know their siblings. Both layers pass the quality filter (nodes do not) after links
    are set, so links to chunks that it drops remain. ``names(doc_id, display_name)`` gives file names, which company, year and report type are
    taken from first; a year that a chunk has none of is that of its document.
    """
    # both are read several times below: written once, their folds and patterns run once
    prepared = stage(prepare(raw), "prepared")
    groups = stage(table_groups(prepared, options), "groups")
    texts = text_parents(prepared, groups, options).withColumns({"rank": F.lit(2), "items": F.lit(None).cast("array<string>"), "periods": F.lit(None).cast("array<string>")})
    t = table_parents(groups).withColumn("rank", F.when(F.col("important"), 0).otherwise(1))
    shared = ["doc_id", "rank", "first_seq", "chunk_type", "content", "quality", "confidence", "page_numbers", "items", "periods", "indicators", "keywords", "chunk_id"]
    ordered = t.select(*shared).unionByName(texts.select(*shared)).selectExpr("*", "row_number() over (partition by doc_id order by rank, first_seq, chunk_id) as seq").drop("rank")
    titled = elements.section_tree(ordered, options.parent_size)
    titled = titled.join(names.dropDuplicates(["doc_id"]), "doc_id", "left") if names is not None else titled.withColumn("display_name", F.lit(None).cast("string"))
    titled = stage(enrich.enrich(titled), "parents")
    year = enrich.report_year(titled, "doc_id").withColumnRenamed("fiscal_year", "report_year")
    meta = ["company_name", "company_code", "fiscal_year", "report_type"]
    parents = titled.join(year, "doc_id").withColumn("fiscal_year", F.coalesce("fiscal_year", "report_year")).drop("report_year")
    parents = parents.withColumns({"density": scores.information_density(F.size("keywords") + F.size("indicators"), F.col("content")), "coherence": scores.coherence(F.col("content"))})
    above = ["section_level", "section_title", "section_path", *meta]
    pieces = windows.child_windows(parents.where("chunk_type <> 'table_group'").select("doc_id", F.col("chunk_id").alias("parent_id"), *above, F.col("content").alias("body")), "body", options.child_size, options.overlap, options.least_size)
    parts = table_children(titled, options).join(parents.select("chunk_id", "doc_id", *above), ["doc_id", "chunk_id"]).withColumnRenamed("chunk_id", "parent_id")
    children = pieces.unionByName(parts, allowMissingColumns=True)
    children = children.withColumns({"chunk_id": text.short_id(F.col("parent_id"), F.col("position").cast("string")), "chunk_type": F.lit("child"), "quality": scores.content_quality(F.col("content"))})
    named = chunks.links(children, "doc_id").withColumnRenamed("parent_id", "chunk_id")
    linked = parents.join(named, ["doc_id", "chunk_id"], "left").drop("items", "periods", "display_name")
    kept = chunks.quality_filter(linked, options.least_quality, options.least_size).unionByName(section_nodes(titled), allowMissingColumns=True)
    return kept, chunks.quality_filter(chunks.siblings(children, "doc_id"), options.least_quality, options.least_size), groups
