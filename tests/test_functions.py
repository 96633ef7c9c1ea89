"""Golden cases of the column expressions, worked out by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import extract, headings, lexicons, scores, text
from quillspark.operators import tables


@pytest.fixture
def value(spark):
    def run(expr, content="x", **more):
        row = {"content": content, **more}
        return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).select(expr.alias("v")).first()["v"]

    return run


C = lambda: F.col("content")


@pytest.mark.parametrize("line", ["第 3 页 / 共 10 页", "page 3 of 10", "1/10", "- 3 -", "17", "iv / x"])
def test_page_markers_go(value, line):
    assert value(text.strip_page_markers(C()), f"甲\n{line}\n\n乙") == "甲\n\n乙"


@pytest.mark.parametrize("line", ["211/985高校名单，共计一百所学校在列", "第三章 财务", "2019年", "x"])
def test_other_lines_stay(value, line):
    assert value(text.strip_page_markers(C()), line) == line


def test_clean_text(value):
    assert value(text.clean_text(C()), " a \t\n b　c\x01d ") == "a b cd"
    assert value(text.clean_text(C()), None) == ""


def test_numbers_list_each_kind_in_turn(value):
    assert value(text.numbers(C()), "收入12.5万元，增长3%，2019年1月2日") == ["12.5万元", "3%", "2019年1月2日", "12.5", "3", "2019", "1", "2"]


def test_sentences_by_script(value):
    assert value(text.sentences(C()), "Mr. A! b\nc") == ["Mr", "A", "b", "c"]
    assert value(text.sentences(C()), "今天天气好。Mr. A很高兴！") == ["今天天气好", "Mr. A很高兴"]


def test_paragraphs(value):
    assert value(text.paragraphs(C()), "a\n \nb") == ["a", "b"]
    long = "。".join(["字" * 100] * 7)
    assert [p.count("。") for p in value(text.paragraphs(C()), long)] == [3, 3, 1]


def test_similarity(value):
    assert value(text.char_similarity(F.lit("abc"), F.lit("bcd"))) == 0.5
    assert value(text.char_similarity(F.lit(""), F.lit("a"))) == 0.0


def test_tokens_and_size(value):
    assert value(text.token_estimate(C()), "资产ab") == 4
    assert value(text.token_estimate(C(), False), "abcdefg") == 1
    assert value(text.size_check(C()), "a" * 1000).message == "分块大小最优"
    assert not value(text.size_check(C()), "a").is_valid


def test_empty_and_null_texts_score_nothing(value):
    for score in (scores.content_quality, scores.chunk_quality, scores.element_quality, scores.coherence, scores.table_text_quality):
        assert value(score(C()), "") == 0.0
        assert value(score(C()), None) == 0.0


def test_quality_by_hand(value):
    # ten characters, all Chinese but one full stop: length 10/500, share 0.9, one mark in 0.2 expected
    assert value(scores.content_quality(C()), "资产负债表已经合并。") == pytest.approx(0.3 * 0.02 + 0.4 * 0.9 + 0.3)
    assert value(scores.element_quality(C()), "资产负债表已经合并。") == pytest.approx(0.2 * 0.02 + 0.3 * 0.9 + 0.2 * 1 + 0.3)


def test_topics(value):
    assert value(scores.topic_overlap(C()), "一句") == 0.5
    assert value(scores.topic_overlap(C()), "abcdefg. hijklmn.") == 0.3
    assert value(scores.topic_overlap(C()), "营业收入增加了。营业收入增加了。") == 0.7


def test_title_score(value):
    near = scores.title_score(C(), F.lit(1), F.lit(3), F.lit(3))
    assert value(near, "七、主要会计数据") == pytest.approx(1.0)
    assert value(scores.title_score(C(), F.lit(3), F.lit(2), F.lit(3)), "七、主要会计数据") == pytest.approx(0.9 * 0.6 + 0.05)
    assert value(near, "长" * 101) == 0


@pytest.mark.parametrize(
    "content, kind",
    [("第三节 公司业务", "title"), ("一、概述", "title"), ("（二）应收", "title"), ("3、存货", "text"), ("12 一、存货", "title"), ("表 1", "title"), ("•要点", "list"), ("普通的一段话", "text"), ("a|b|c\nd|e|f\ng|h|i", "table"), ("a|b|c|d|e", "text")],
)
def test_element_type(value, content, kind):
    assert value(headings.element_type(C()), content) == kind


@pytest.mark.parametrize("content, level", [("第一章 总则", 1), ("二、范围", 2), ("（三）方法", 3), ("4、步骤", 4), ("4、2019年的情况", None), ("4、完成了。", None), ("正文", None)])
def test_heading_level(value, content, level):
    assert value(headings.heading_level(C()), content) == level


def test_heading_title(value):
    assert value(headings.heading_title(C()), "第一章总则\n正文") == "第一章 总则"


def test_filename(value):
    name = "2020-01-21__某某智能工程股份有限公司__300617__某某__2019年__年度报告.pdf"
    m = value(extract.filename_metadata(C()), name)
    assert (m.company_code, m.fiscal_year, m.report_type, m.company_name) == ("300617", 2019, "年度报告", "某某智能工程股份有限公司")
    half = name.replace("年度报告", "半年度报告")
    assert value(extract.filename_metadata(C()), half).report_type == "年度报告"
    assert value(extract.filename_metadata(C(), True), half).report_type == "半年度报告"
    assert value(extract.filename_metadata(C()), "a__b.pdf").report_type is None


def test_codes_dates_periods(value):
    assert value(extract.stock_code(C()), "证券代码：300617") == "300617"
    assert value(extract.stock_code(C()), "编号123456，代码（600000）") == "600000"
    assert value(extract.fiscal_dates(C()), "2024.3.31和2023.12.31") == ["2024-3-31", "2023-12-31"]
    assert value(extract.time_periods(C()), "2019年度，2018年3月，第一季度") == ["2018-3", "2019", "一"]
    assert value(extract.fiscal_period(C()), "2019年第三季度") == "2019年第三季度"


def test_units_and_types(value):
    none = F.lit(None).cast("string")
    assert value(extract.monetary_unit(F.lit("单位：万元"), none, C())) == "万元"
    assert value(extract.monetary_unit(none, none, C()), "合计（百万）") == "人民币百万元"
    assert value(extract.table_type(C()), "营业收入与净利润") == "利润表"
    assert value(extract.statement_type(none, C()), "本年收入") == "income_statement"
    assert value(extract.statement_type(none, C()), "其他") == "other"


def test_indicators_are_capped_and_amounts_speak_for_themselves(value):
    assert len(value(extract.financial_indicators(C()), "".join(lexicons.INDICATORS))) == 10
    assert value(extract.financial_indicators(C()), "共1,200.5万元") == ["金额数据"]
    assert value(extract.financial_indicators(C()), "abc") == []


def test_clean_items(value):
    assert value(extract.clean_items(F.array(F.lit("、存货，"), F.lit("他长期"), F.lit("货"), F.lit("存货")))) == ["存货"]


def test_tables(value):
    body = "项目 | 2019 | 2018\n--- | --- | ---\n收入 | 1,200 | -3.5%\n说明"
    assert value(tables.parse_rows(C()), body) == [["项目", "2019", "2018"], ["收入", "1,200", "-3.5%"]]
    n = value(extract.numeric_data(tables.parse_rows(C()), C()), body)
    assert (n.min, n.max, n.has_negative, n.has_percentage) == (-3.5, 1200.0, True, True)
    assert value(tables.to_markdown(C()), "a\tb\nc") == "| a | b |\n| --- | --- |"
    assert value(tables.to_markdown(C()), "nothing") == "nothing"
    assert value(tables.dimensions(C()), body).asDict() == {"n_rows": 3, "n_cols": 3}
    assert value(tables.rows_to_text(tables.parse_rows(C())), "a|b\nc|d") == "a | b\n" + "-" * 50 + "\nc | d"


def test_table_noise(value):
    body = "一\n二\n三\n项目 | 值\n收入 | 1\n四\n五"
    assert value(tables.trim_noise(C()), body) == "项目 | 值\n收入 | 1\n四\n五"
    assert value(tables.clean_markers(C()), "*甲\n12。*乙*\n**丙**") == "甲\n乙\n**丙**"


def test_lexicons_keep_their_order():
    assert lexicons.STATEMENTS[0] == "资产负债表" and lexicons.FINANCIAL_TERMS[:3] == ("资产", "负债", "所有者权益")
    assert len(lexicons.INDICATORS) == 97 and len(set(lexicons.INDICATORS)) == 97


def test_connectives_are_counted_without_writing_texts_anew(spark):
    rng = random.Random(2)
    words = [w for group in lexicons.CONNECTIVES.values() for w in group]
    texts = [None, "", *("".join(rng.choice([*words, "甲", "a ", "。"]) for _ in range(rng.randint(1, 400))) for _ in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    scored = df.select("content", scores.connector_score(C()).alias("x"))
    for c, x in scored.collect():
        c = c or ""
        total = sum((len(c) - len(c.replace(w, ""))) // len(w) for w in words)
        kinds = sum(any(w in c for w in group) for group in lexicons.CONNECTIVES.values())
        assert x == pytest.approx(min(1.0, min(1.0, total / max(1.0, len(c) / 500)) + min(0.3, kinds * 0.1)))
    assert "replace(" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_paragraphs_of_a_long_text(spark):
    text_of = "".join(f"第{i}句。" for i in range(60_000))
    began = time.perf_counter()
    got = spark.createDataFrame([(text_of,)], "content string").select(text.paragraphs(C()).alias("p")).first().p
    assert len(got) == 20_000 and "".join(got) == text_of and got[1] == "第3句。第4句。第5句。"
    assert time.perf_counter() - began < 40
