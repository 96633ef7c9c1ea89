"""Accounting regimes of reports and metrics that stay comparable across them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import has_any

FIELDS = tuple(lx.REGIME_WORDS)
_ADOPTED = "(自.*?起|将|已)?执行.*?新?"
#: (pattern, field, whether it names a first year), the later ones overruling the earlier.
_DISCLOSED = tuple((_ADOPTED + p, f, False) for f, p in zip(FIELDS, ("收入准则", "金融工具.*?准则", "租赁准则"), strict=True)) + tuple(
    (f"自([0-9]{{4}})年1月1日起.*执行.*第{number}号", f, True) for f, number in zip(FIELDS, (14, 22, 21), strict=True)
)


@dataclass(frozen=True)
class Options:
    enabled: bool = True
    first_year: int = 2017
    last_year: int = 2021
    #: First year in which a field counts as new without other evidence.
    thresholds: tuple[int, int, int] = (2019, 2019, 2021)
    before: str = "old"
    after: str = "new"
    #: Elements whose text may disclose a regime.
    elements: int = 300


def _flag(text: Column, year: Column, pattern: str, dated: bool) -> Column:
    """new or old where the pattern occurs, else null; a negation within twenty characters of the first match means old."""
    matched = F.regexp_extract(text, pattern, 0)
    start = F.instr(text, matched)
    around = F.substring(text, F.greatest(F.lit(1), start - 20), F.length(matched) + F.least(F.lit(40), start + 19))
    negated = has_any(around, lx.NEGATIONS)
    positive = F.when(year >= F.regexp_extract(text, pattern, 1).try_cast("int"), "new").otherwise("old") if dated else F.lit("new")
    return F.when(text.rlike(pattern), F.when(negated, "old").otherwise(positive))


def profiles(elements: DataFrame, key: str = "doc_id", options: Options = Options()) -> DataFrame:
    """``(key, fiscal_year, revenue, financial_instruments, lease, decided_by)`` of reports ``(key, seq, fiscal_year, element_type, content)``.

    Outside the years of transition the default decides. Inside them, disclosures come first (the later pattern wins), then words in tables, then
    the year. A report without a year is unknown throughout. Null contents count as absent.
    """
    w = Window.partitionBy(key).orderBy("seq")
    e = elements.where("content is not null and content <> ''").withColumn("_r", F.row_number().over(w))
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("_r", "content")))), lambda x: x["content"]), " ")
    table = F.col("element_type") == "table"
    # tables are asked word by word, which needs no text gathered
    words = {f"_{f}_{r}": F.coalesce(F.max(F.when(table, has_any(F.col("content"), ws))), F.lit(False)) for f, by in lx.REGIME_WORDS.items() for r, ws in by.items() if ws}
    reports = elements.groupBy(key).agg(F.max("fiscal_year").alias("fiscal_year"))
    facts = e.groupBy(key).agg(joined(F.col("_r") <= options.elements).alias("_text"), *(v.alias(k) for k, v in words.items()))
    out = reports.join(facts, key, "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    year, text = F.col("fiscal_year"), F.col("_text")
    inside = year.between(options.first_year, options.last_year)
    for f, limit in zip(FIELDS, options.thresholds, strict=True):
        # of two patterns for a field the later overwrites the earlier
        said = F.coalesce(*(_flag(text, year, p, dated) for p, name, dated in reversed(_DISCLOSED) if name == f))
        new = F.coalesce(F.col(f"_{f}_new"), F.lit(False))
        old = F.coalesce(F.col(f"_{f}_old"), F.lit(False)) if f"_{f}_old" in words else F.lit(False)
        worded = F.when(new, "new").when(old, "old")
        out = out.withColumns({f"_said_{f}": said, f"_known_{f}": F.coalesce(said, worded), f"_year_{f}": F.when(year >= limit, "new").otherwise("old")})
    all_said = F.lit(True)
    any_known = F.lit(False)
    all_known = F.lit(True)
    for f in FIELDS:
        all_said = all_said & F.col(f"_said_{f}").isNotNull()
        any_known = any_known | F.col(f"_known_{f}").isNotNull()
        all_known = all_known & F.col(f"_known_{f}").isNotNull()
    off = year.isNull() | F.lit(not options.enabled)
    flag = lambda f: F.when(off, "unknown").when(year < options.first_year, options.before).when(year > options.last_year, options.after).otherwise(F.coalesce(f"_known_{f}", f"_year_{f}"))
    decided = (
        F.when(off, "unknown")
        .when(year < options.first_year, "default_before_transition")
        .when(year > options.last_year, "default_after_transition")
        .when(inside & all_said, "explicit_note")
        .when(all_known, "table_keywords")
        .when(any_known, "table_keywords_with_year_fallback")
        .otherwise("year_threshold")
    )
    return out.select(key, "fiscal_year", *(flag(f).alias(f) for f in FIELDS), decided.alias("decided_by"))


def metric_map(spark: SparkSession) -> DataFrame:
    """``(metric, category, regime, ord, subject)``; a constant of a few dozen rows."""
    rows = [(m, field, regime, i, s) for m, (field, *lists) in lx.METRICS.items() for regime, subjects in zip(("new", "old"), lists, strict=True) for i, s in enumerate(subjects.split() or [None])]
    return spark.createDataFrame(rows, "metric string, category string, regime string, ord int, subject string")


NOTES = {
    "rd_old": "旧准则：研发费用通常包含在管理费用中，未单独列示，数值可能为0或偏低。",
    "contract_new": "新准则口径：合同负债不含增值税。",
    "contract_old": "旧准则口径：预收款项/预收账款含增值税，跨准则对比需注意税率差异。",
    "notes_financing": "已包含应收款项融资（用于背书/贴现的票据）。",
    "funds_lent": "已加回拆出资金以还原集团资金池全貌。",
}


def parse_amount(c: Column) -> Column:
    """A figure with or without separators of thousands; what is no figure gives null."""
    return F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")


def metrics(values: DataFrame, profile: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, period, metric, value, subjects_used, standard_used, profile_flag, note)`` for each report, period and metric.

    ``values(key, period, subject, amount)``: amounts of a subject are summed. ``profile(key, revenue, financial_instruments, lease)``; reports without one count as
    unknown, which prefers the new regime. A regime is found with any amount of its subjects, zero too; if the preferred one is not, the other is tried.
    Subjects whose sum is zero are not listed. ``subjects_used`` is joined by ``+`` in the order of the mapping.
    """
    spark = values.sparkSession
    mapping = metric_map(spark)
    sums = values.where("subject is not null and amount is not null").groupBy(key, "period", "subject").agg(F.sum("amount").alias("amount"))
    periods = values.select(key, "period").distinct()
    found = sums.join(F.broadcast(mapping), "subject").groupBy(key, "period", "metric", "regime").agg(F.sum("amount").alias("value"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("amount") != 0, F.struct("ord", "subject")))), lambda x: x["subject"]), "+").alias("used"))
    wide = found.groupBy(key, "period", "metric").agg(*(F.first(F.when(F.col("regime") == r, F.struct("value", "used")), ignorenulls=True).alias(r) for r in ("new", "old")))
    names = F.broadcast(mapping.select("metric", "category").distinct())
    flags = profile.select(key, *FIELDS)
    out = periods.crossJoin(names).join(wide, [key, "period", "metric"], "left").join(flags, key, "left")
    flag = F.coalesce(F.when(F.col("category") == "revenue", F.col("revenue")).when(F.col("category") == "lease", F.col("lease")).otherwise(F.col("financial_instruments")), F.lit("unknown"))
    prefers_new = flag != "old"
    first, second = F.when(prefers_new, F.col("new")).otherwise(F.col("old")), F.when(prefers_new, F.col("old")).otherwise(F.col("new"))
    picked = F.coalesce(first, second)
    own, other = F.when(prefers_new, "new").otherwise("old"), F.when(prefers_new, "old").otherwise("new")
    standard = F.when(first.isNull() & second.isNotNull(), F.concat(other, F.lit("_fallback"))).otherwise(own)
    out = out.select(key, "period", "metric", F.coalesce(picked["value"], F.lit(0.0)).alias("value"), F.coalesce(picked["used"], F.lit("")).alias("subjects_used"), standard.alias("standard_used"), flag.alias("profile_flag"))
    has = lambda s: F.array_contains(F.split("subjects_used", r"\+"), s)
    note = (
        F.when((F.col("metric") == "rd_expenses") & (F.startswith("standard_used", F.lit("old")) | (F.col("value") == 0)), NOTES["rd_old"])
        .when((F.col("metric") == "contract_liabilities_like") & has("合同负债"), NOTES["contract_new"])
        .when((F.col("metric") == "contract_liabilities_like") & (has("预收款项") | has("预收账款")), NOTES["contract_old"])
        .when((F.col("metric") == "notes_receivable_broad") & has("应收款项融资"), NOTES["notes_financing"])
        .when((F.col("metric") == "monetary_funds_broad") & has("拆出资金"), NOTES["funds_lent"])
        .otherwise("")
    )
    return out.withColumn("note", note)
