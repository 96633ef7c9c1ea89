"""Facts found in text by word lists and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import AMOUNT, COMPANY, all_matches, has_any, let, strip, words_in

_AMOUNT_FORMS = "|".join((r"[0-9]{1,3}(,[0-9]{3})*\.?[0-9]*\s*(万元|亿元|千万|元)", r"[0-9]+\.[0-9]+%", r"[￥$]\s*[0-9]+"))


def financial_indicators(c: Column) -> Column:
    """The first ten indicator words; without any, ``金额数据`` where an amount, percentage or currency sign stands."""
    amount = F.when(c.rlike(_AMOUNT_FORMS), F.array(F.lit("金额数据"))).otherwise(F.array().cast("array<string>"))
    return let(F.slice(words_in(c, lx.INDICATORS), 1, 10), lambda found: F.when(F.size(found) > 0, found).otherwise(amount))


def keywords(c: Column, most: int = 10) -> Column:
    """Keyword terms and the first three amounts."""
    return F.slice(F.concat(words_in(c, lx.KEYWORD_TERMS), F.slice(all_matches(c, AMOUNT), 1, 3)), 1, most)


def numeric_data(rows: Column, content: Column) -> Column:
    """struct(count, min, max, has_negative, has_percentage) of the figures in a table's cells; null without any."""
    text = F.filter(F.flatten(rows), lambda x: x.isNotNull() & (x != ""))
    found = F.flatten(F.transform(text, lambda x: all_matches(x, r"-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?%?")))
    values = F.transform(found, lambda x: F.translate(x, ",%", "").cast("double"))
    return let(
        values,
        lambda v: F.when(
            F.size(v) > 0,
            F.struct(F.size(v).alias("count"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), (F.array_min(v) < 0).alias("has_negative"), F.contains(content, F.lit("%")).alias("has_percentage")),
        ),
    )


def table_type(c: Column) -> Column:
    """First type of which two words occur, or null."""
    out = None
    for name, words in lx.TABLE_TYPES.items():
        test = F.size(words_in(c, words)) >= 2
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def statement_type(title: Column, content: Column) -> Column:
    """Type of statement by words in the title and the first 500 characters, then by pairs of words, else ``other``."""
    c = F.lower(F.concat(F.when(title.isNotNull(), F.concat(title, F.lit(" "))).otherwise(F.lit("")), F.left(F.coalesce(content, F.lit("")), F.lit(500))))
    out = None
    for name, words in lx.STATEMENT_TYPES.items():
        out = F.when(has_any(c, words), name) if out is None else out.when(has_any(c, words), name)
    has = lambda w: F.contains(c, F.lit(w))
    return out.when(has("资产") & has("负债"), "balance_sheet").when(has("收入") & (has("成本") | has("费用")), "income_statement").when(has("现金") & has("流量"), "cash_flow").otherwise("other")


_TAIL = r"[^\s。，]"
_ITEM_FORMS = (
    "(?:衍生|交易性)金融(?:负债|资产)",
    f"其他应[付收]{_TAIL}{{0,6}}",
    *(f"{head}{_TAIL}{{1,8}}" for head in ("应收", "应付", "预[付收]")),
    *(f"{_TAIL}{{2,8}}{end}" for end in ("资产", "负债")),
)


def accounting_items(c: Column) -> Column:
    """Accounting items of a table, distinct and sorted: listed ones and such as are built like them, without fragments of sentences."""
    listed = words_in(c, sorted({*lx.BROAD_ITEMS, *lx.STANDARD_ITEMS}))
    built = F.flatten(F.array(*(all_matches(c, p) for p in _ITEM_FORMS)))
    known = F.array(*map(F.lit, sorted({*lx.COMMON_ITEMS, *lx.STANDARD_ITEMS})))

    def good(x: Column) -> Column:
        clean = F.length(x).between(2, 15) & ~x.rlike("[，。、；：,:%（）()A-Za-z0-9-]") & ~has_any(x, lx.NOISE_WORDS) & ~x.rlike("[和或的则为及]$")
        return clean & (F.array_contains(known, x) | x.rlike("^(" + "|".join(lx.ITEM_PREFIXES) + ")"))

    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(listed, built), strip), good)))


def clean_items(items: Column) -> Column:
    """Items without outer punctuation, in first order; very short and cut ones go."""
    bare = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[、,，。；：\s]+", ""), r"[、,，。；：\s]+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 2) & ~(F.startswith(x, F.lit("他")) & (F.length(x) < 4))))


_PERIODS = (("([0-9]{4})年度", 1), ("([0-9]{4})年([0-9]{1,2})月", 2), ("第([一二三四])季度", 1), ("([0-9]{4})年?第([一二三四])季度", 2), ("([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})", 3))


def _joined(c: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern, each as its groups joined by hyphens."""
    out = all_matches(c, pattern, 1)
    for g in range(2, groups + 1):
        out = F.zip_with(out, all_matches(c, pattern, g), lambda a, b: F.concat(a, F.lit("-"), b))
    return out


def time_periods(*texts: Column) -> Column:
    """Periods named in the texts, distinct and sorted; null texts count as empty."""
    found = [_joined(F.coalesce(t, F.lit("")), p, n) for t in texts for p, n in _PERIODS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


_UNITS = ("单位[：:]\\s*(.*元)", "币种[：:]\\s*(.+)", "人民币(.*元)", "\\((.+元)\\)", "（(.+元)）")


def monetary_unit(caption: Column, title: Column, content: Column) -> Column:
    """Unit of amounts: as the caption, else the title says, else by the largest unit named in the first 200 characters."""
    said = [F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for t in (caption, title) for p in _UNITS]
    c = F.left(content, F.lit(200))
    has = lambda w: F.contains(c, F.lit(w))
    ladder = F.when(has("万元"), "人民币万元").when(has("千元"), "人民币千元").when(has("百万"), "人民币百万元").when(has("元"), "人民币元")
    return F.coalesce(*said, ladder)


def company_name(c: Column) -> Column:
    return F.when(c.rlike(COMPANY), F.regexp_extract(c, COMPANY, 0))


def stock_code(c: Column, bare: bool = True) -> Column:
    """Code of six figures that begins with 0, 3, 6 or 8: named, in brackets, or (``bare``) standing alone; first form wins."""
    forms = [r"(?:股票代码|证券代码)[：:\s]*([0-9]{6})", "[（(]([0-9]{6})[)）]"] + (["(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)"] if bare else [])
    codes = [F.regexp_extract(c, p, 1) for p in forms]
    return F.coalesce(*(F.when(x.rlike("^[0368]"), x) for x in codes))


def fiscal_period(c: Column) -> Column:
    """Year, and quarter where one is named with a year."""
    year = F.regexp_extract(c, r"([0-9]{4})\s*年", 1)
    quarter = F.regexp_extract(c, r"第([一二三四])\s*季度|([0-9])\s*季度", 1)
    figure = F.regexp_extract(c, r"第([一二三四])\s*季度|([0-9])\s*季度", 2)
    named = F.when(quarter != "", quarter).when(figure != "", figure)
    return F.when(year != "", F.concat(year, F.lit("年"), F.coalesce(F.concat(F.lit("第"), named, F.lit("季度")), F.lit(""))))


def first_listed(c: Column, lexicon: tuple[str, ...], size: int) -> Column:
    """First word of the list that the first ``size`` characters contain, or null."""
    return F.get(words_in(F.left(c, F.lit(size)), lexicon), F.lit(0))


def report_section(c: Column) -> Column:
    return first_listed(c, lx.SECTIONS, 100)


def statement_name(c: Column) -> Column:
    return first_listed(c, lx.STATEMENTS, 200)


_NUMBERED = (r"[一二三四五六七八九十0-9]+、\s*\S+", r"[(（][一二三四五六七八九十0-9]+[)）]\s*\S+", r"[0-9]+\.\s*\S+", r"[(（][0-9]+[)）]\s*\S+")


def element_items(c: Column) -> Column:
    """Numbered headings that name accounting items: those of the first numbering that occurs."""
    out = None
    for p in _NUMBERED:
        found = all_matches(c, p)
        out = F.when(F.size(found) > 0, found) if out is None else out.when(F.size(found) > 0, found)
    out = out.otherwise(F.array().cast("array<string>"))
    return F.filter(out, lambda x: has_any(x, lx.STANDARD_ITEMS) & ~has_any(x, lx.NON_ITEMS))


_DATES = (r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日", r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})", "([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})")


def fiscal_dates(c: Column) -> Column:
    """All dates of the first form that occurs, as year-month-day."""
    out = None
    for p in _DATES:
        found = _joined(c, p, 3)
        out = F.when(F.size(found) > 0, found) if out is None else out.when(F.size(found) > 0, found)
    return out.otherwise(F.array().cast("array<string>"))


def filename_metadata(name: Column, strict_halfyear: bool = False) -> Column:
    """struct(company_name, company_code, fiscal_year, report_type) of a name of five or more parts joined by two underscores.

    Half-yearly reports count as yearly, as both names hold the same two characters, unless ``strict_halfyear``.
    """
    parts = F.split(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), "__")
    ok = F.size(parts) >= 5
    first = lambda test: F.when(ok, F.get(F.filter(parts, test), F.lit(0)))
    kind = F.get(F.filter(F.reverse(parts), lambda p: p.rlike("年度报告|年报|季度报告|季报|半年")), F.lit(0))
    year, half, quarter = F.when(kind.rlike("年度|年报"), "年度报告"), F.when(kind.rlike("半年"), "半年度报告"), F.when(kind.rlike("季度|季报"), "季度报告")
    order = (half, year, quarter) if strict_halfyear else (year, half, quarter)
    return F.struct(
        first(lambda p: F.contains(p, F.lit("公司"))).alias("company_name"),
        first(lambda p: p.rlike("^[0-9]{6}$")).alias("company_code"),
        F.regexp_extract(first(lambda p: p.rlike("^[0-9]{4}年$")), "^([0-9]{4})", 1).cast("int").alias("fiscal_year"),
        F.when(ok, F.coalesce(*order)).alias("report_type"),
    )


def fiscal_year(c: Column) -> Column:
    """Year of a yearly report named in the text, else the first year in it."""
    named, any_year = F.regexp_extract(c, r"([0-9]{4})\s*年度?\s*(?:年度)?报告", 1), F.regexp_extract(c, "([0-9]{4})年", 1)
    return F.coalesce(F.when(named != "", named), F.when(any_year != "", any_year)).cast("int")


def year_of_filename(name: Column) -> Column:
    """A year of this century in a file's name; the fallback where no chunk has one."""
    return F.regexp_extract(name, "(20[0-9]{2})", 1).try_cast("int")
