import pytest
from pyspark.sql import functions as F

from quillspark.operators import enrich
from quillspark.sources import config, elements as readers

NAME = "2020-01-21__某某工程股份有限公司__300617__某某__2019年__年度报告.pdf"


def test_file_name_wins(spark):
    rows = [(1, NAME, "海岳科技股份有限公司（600000）2018年度报告", "资产负债表", None), (2, "x.pdf", "海岳科技股份有限公司（600000）2018年度报告", "季度报告", "abc")]
    df = spark.createDataFrame(rows, "id int, display_name string, content string, report_type string, company_code string")
    got = {r.id: (r.company_name, r.company_code, r.fiscal_year, r.report_type) for r in enrich.enrich(df).collect()}
    assert got[1] == ("某某工程股份有限公司", "300617", 2019, "年度报告")
    assert got[2] == ("海岳科技股份有限公司", "600000", 2018, "季度报告")


def test_year_of_a_report(spark):
    rows = [(1, 2, 2018, "a.pdf"), (1, 1, None, "a.pdf"), (1, 3, 2020, "a.pdf"), (2, 1, None, "报告2017.pdf"), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "doc int, seq int, fiscal_year int, display_name string")
    assert {r.doc: r.fiscal_year for r in enrich.report_year(df, "doc").collect()} == {1: 2018, 2: 2017, 3: None}


def test_split_dispatch(spark):
    lines = spark.createDataFrame([(t, i, x) for t in (1, 2, 3) for i, x in enumerate(["存货 1", "合计 2", "商誉 3"])], "table_id int, line_no int, line string")
    meta = spark.createDataFrame([(1, ["存货", "商誉"], ["2019"]), (2, [], ["2018", "2019"]), (3, None, None)], "table_id int, items array<string>, periods array<string>")
    got = sorted((r.table_id, r.part_no, r.how, r.content) for r in enrich.split_table(lines, meta, 8).collect())
    assert got == [(1, 0, "items", "存货 1\n合计 2"), (1, 1, "items", "商誉 3"), (2, 0, "periods", "存货 1"), (2, 1, "periods", "合计 2\n商誉 3"), (3, 0, "size", "存货 1\n合计 2"), (3, 1, "size", "商誉 3")]


def test_tables_are_raised_and_flagged(spark):
    df = spark.createDataFrame([("营业收入 净利润", 0.5), ("x", 0.9), ("x", 0.5)], "content string, quality double")
    assert sorted((r.quality, r.high_value) for r in enrich.enhanced(df).collect()) == [(0.5, False), (0.6, True), (0.9, True)]
    assert df.select(enrich.low_quality(F.lit(3), F.lit(3), F.col("quality")).alias("x")).where("x").count() == 2
    assert df.select(enrich.numeric_summary().alias("x")).first().x["count"] == 0


def test_preview_and_export(spark):
    rows = [("parent", "a", "text", False, [2, 3], 4, None, ["k"], None, "文"), ("child", "b", "table_group", None, None, 1, 3, None, "节", None), ("parent", "c", "section", False, None, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "layer string, chunk_id string, chunk_type string, is_table boolean, page_numbers array<int>, page_number int, position int, child_ids array<string>, section_title string, content string")
    ids = lambda **k: sorted(r.chunk_id for r in enrich.preview(df, **k).collect())
    assert ids() == ["a"] and ids(children=True) == ["a", "b"] and ids(sections=True) == ["a", "c"] and ids(children=True, tables_only=True) == ["b"]
    got = {r.chunk_id: (r.is_table, r.entry_page, r.child_count, r.content_len) for r in enrich.export_rows(df).collect()}
    assert got == {"a": (False, 2, 1, 1), "b": (True, 1, 0, 0), "c": (False, None, 0, 1)}


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1, "chunking": {"a": 2}}')
    s = config.load(str(tmp_path / "c.json"))
    assert config.section(s, "chunking")["a"] == 2 and config.section(s, "none")["a"] == 1
    assert config.load("/no/such/file") == {} and config.load({"x": 1}) == {"x": 1}
    assert config.first_of({"a": {"b": "no"}, "c": "0.4"}, ["a.b", "z", "c"], 0.3) == 0.4
    assert config.first_of({}, ["a"], 0.3) == 0.3


def test_strategies():
    assert config.strategies(["pdfplumber", "text"], ["text"]) == ["text"]
    with pytest.raises(ValueError, match="unknown"):
        config.strategies(["nothing"], ["text"])
    with pytest.raises(ValueError, match="none of"):
        config.strategies(["pdfplumber"], ["text"])
    assert set(config.available()) == set(readers.EXTERNAL)


def test_one_bad_path_does_not_end_the_others(spark, tmp_path):
    (tmp_path / "a.txt").write_text("一段足够长的文字，用来测试。")
    good, bad = readers.read_each(spark, "text", [str(tmp_path / "a.txt"), str(tmp_path / "none.txt")])
    assert good.count() == 1 and [r.path for r in bad.collect()] == [str(tmp_path / "none.txt")]
