"""Cleaning, counting and splitting of text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

#: What stripping removes: ASCII blanks, the no-break and the ideographic space.
BLANKS = " \t\n\r\x0b\x0c\xa0　"
CJK = "[一-鿿]"
AMOUNT = r"[0-9]+\.?[0-9]*[万亿千百]?元"
PERCENT = r"[0-9]+\.?[0-9]*%"
DATE = r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日"
NUMBER = r"[0-9]+\.?[0-9]*"
COMPANY = (
    CJK + "+(?:企业|发展|铁路|航空|农业|教育|文化|物流|贸易|建设|投资|实业|化工|钢铁|汽车|通信|电子|医药|能源|地产|保险|证券|银行|金融|技术|科技|控股|集团|股份)"
    "(?:（[^）]*）)?(?:有限责任|有限)?(?:股份)?(?:企业|公司)"
)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def words_in(c: Column, lexicon: Iterable[str]) -> Column:
    """Words of the lexicon that occur in the text, in the lexicon's order."""
    return F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(c, w))


def hits(c: Column, lexicon: Iterable[str]) -> Column:
    """How many words of the lexicon occur."""
    return F.size(words_in(c, lexicon))


def has_any(c: Column, lexicon: Iterable[str]) -> Column:
    words = [re.escape(w) for w in lexicon]
    return c.rlike("|".join(words)) if words else F.lit(False)


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def cjk_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, cjk_count(c) / F.length(c)).otherwise(F.lit(0.0))


def occurrences(c: Column, w: Column) -> Column:
    return ((F.length(c) - F.length(F.replace(c, w))) / F.length(w)).cast("int")


def is_chinese(c: Column, threshold: float = 0.3) -> Column:
    return cjk_ratio(c) >= threshold


def numbers(c: Column) -> Column:
    """Amounts, percentages, dates and plain numbers, one kind after another; one stretch may appear in several."""
    return F.concat(*(all_matches(c, p) for p in (AMOUNT, PERCENT, DATE, NUMBER)))


def financial_terms(c: Column) -> Column:
    return words_in(c, lx.FINANCIAL_TERMS)


def clean_text(c: Column) -> Column:
    """Blanks collapsed, control characters dropped, outer blanks stripped; null gives ''."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s 　]+", " ")
    return strip(F.regexp_replace(one, r"[\p{Cntrl}&&[^\t\n\r]]", ""))


_S, _D, _ROMAN = r"\s*", "[0-9]+", "[cdilmvx]+"
_OF = f"{_S}/{_S}"
_PAGE = f"(?i)^(第?{_S}{_D}{_S}页({_OF}共?{_S}{_D}{_S}页)?|page{_S}{_D}({_S}of{_S}{_D})?|{_D}{_OF}{_D}|-?{_S}{_D}{_S}-?|{_ROMAN}{_OF}{_ROMAN})$"
_FIGURES = "^[-./0-9\\s]{1,15}$"


def is_page_marker(line: Column) -> Column:
    """A short line that is nothing but a page number in one of its usual forms."""
    bare = strip(line)
    return (F.length(bare) <= 15) & (bare.rlike(_PAGE) | bare.rlike(_FIGURES))


def strip_page_markers(c: Column) -> Column:
    """The text without lines that are page markers; blank lines stay."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_page_marker(x)), "\n")


_NOISE = (
    "^\\*?[一-鿿A-Za-z0-9（）()·\"、\\\\s-]{0,80}年度报告全文\\s*$",
    f"^{_D}{_S}$",
    f"^{_D}{_S}[／/]{_S}{_D}{_S}$",
    f"^[第共]{_S}{_D}{_S}页{_S}$",
)


def is_header_noise(c: Column) -> Column:
    """A block that is a running head or foot only."""
    bare = strip(c)
    found = bare == ""
    for p in _NOISE:
        found = found | bare.rlike(p)
    return found


def drop_header_prefix(c: Column) -> Column:
    """A running head glued to the text goes, and so does a single star before text, boxes or figures."""
    bare = strip(F.regexp_replace(strip(c), r"^\*?[^\n]{0,80}年度报告全文\s*", ""))
    return F.when(bare.rlike("^\\*[（□√一-鿿0-9-]"), strip(F.substring(bare, 2, 2**31 - 1))).otherwise(bare)


def paragraphs(c: Column) -> Column:
    """Split at blank lines; a single long paragraph is packed anew, three sentences to one."""
    sentences = F.transform(F.filter(F.split(c, r"。\s*"), lambda s: strip(s) != ""), lambda s: F.concat(s, F.lit("。")))

    # split once: named inside the function over places, the sentences would be split again for each
    def packed(sentences: Column) -> Column:
        n = F.size(sentences)
        threes = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / 3).cast("int") - 1)), lambda i: F.array_join(F.slice(sentences, i * 3 + 1, 3), ""))
        return F.when(n > 0, threes).otherwise(F.array().cast("array<string>"))

    return let(F.split(c, r"\n\s*\n"), lambda parts: F.when((F.size(parts) == 1) & (F.length(c) > 500), let(sentences, packed)).otherwise(parts))


def sentences(c: Column) -> Column:
    """Stripped sentences; Latin full stops separate only where less than half of the text is Chinese."""
    chosen = F.when(cjk_ratio(c) < 0.5, F.split(c, r"[.!?\n]+")).otherwise(F.split(c, r"[。！？\n]+"))
    return F.filter(F.transform(chosen, strip), lambda s: s != "")


def char_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; 0 if either text is empty."""
    x, y = (F.array_distinct(F.split(t, "")) for t in (a, b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def merge_texts(parts: Column, separator: str = "\n\n") -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda s: s != ""), separator)


def snippet(c: Column, size: int = 120) -> Column:
    bare = strip(F.coalesce(c, F.lit("")))
    return F.concat(F.left(bare, F.lit(size)), F.when(F.length(bare) > size, F.lit("...")).otherwise(F.lit("")))


def review_snippet(c: Column, size: int = 80) -> Column:
    bare = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.concat(F.left(bare, F.lit(size)), F.when(F.length(bare) > size, F.lit("...")).otherwise(F.lit("")))


def display(chunk_id: Column, content: Column, size: int = 200) -> Column:
    body = F.concat(F.left(content, F.lit(size)), F.when(F.length(content) > size, F.lit("...")).otherwise(F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("[分块 "), F.coalesce(chunk_id, F.lit("unknown")), F.lit("]")), F.concat(F.lit("内容: "), body))


def token_estimate(c: Column, chinese: bool = True) -> Column:
    """1.5 tokens for a Chinese and 0.5 for another character, or a quarter token for any."""
    if not chinese:
        return F.floor(F.length(c) / 4).cast("int")
    return F.floor(cjk_count(c) * 1.5 + (F.length(c) - cjk_count(c)) * 0.5).cast("int")


def size_check(c: Column, least: int = 50, most: int = 4000, best: int = 1000) -> Column:
    """struct(size, is_valid, is_optimal, message)."""
    n = F.length(c)
    optimal = F.abs(n - best) < best * 0.2
    message = (
        F.when(n < least, F.concat(F.lit("分块过小 ("), n, F.lit(f"字符 < {least})")))
        .when(n > most, F.concat(F.lit("分块过大 ("), n, F.lit(f"字符 > {most})")))
        .when(optimal, F.lit("分块大小最优"))
        .otherwise(F.lit("分块大小可接受"))
    )
    return F.struct(n.alias("size"), n.between(least, most).alias("is_valid"), optimal.alias("is_optimal"), message.alias("message"))


def metadata(c: Column) -> Column:
    """struct of length, ratio, counts, flags, years and companies of a text; lists are distinct and sorted."""
    return F.struct(
        F.length(c).alias("length"),
        cjk_ratio(c).alias("chinese_ratio"),
        F.size(sentences(c)).alias("sentence_count"),
        c.rlike("[0-9]").alias("has_numbers"),
        has_any(c, lx.FINANCIAL_TERMS).alias("has_financial_terms"),
        (occurrences(c, F.lit("\n")) + 1).alias("line_count"),
        F.array_sort(F.array_distinct(all_matches(c, "([0-9]{4})年", 1))).alias("years"),
        F.array_sort(F.array_distinct(all_matches(c, COMPANY))).alias("companies"),
    )


def short_id(*parts: Column) -> Column:
    """Eight hexadecimal digits that name what the parts name; the same on every run."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
