"""Derived tables of Chinese report content: the same SQL text for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only texts whose dialects differ.
LINES = {
    "spark": "select doc_id, pos as seq, col as line from (select doc_id, posexplode(split(text, '\\n')) from {documents})",
    "duckdb": "select doc_id, cast(i-1 as int) as seq, a[i] as line from (select doc_id, string_split(text, chr(10)) a, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents)",
}
ELEMENTS = """select doc_id, seq, cast(floor(seq / 10.0) as int) + 1 as page_number,
  case when seq % 23 = 0 then concat('第', substr('一二三四五六七八九十', cast(floor(seq / 23.0) as int) % 10 + 1, 1), '节 公司简介')
       when seq % 11 = 0 then concat(substr('一二三四五六七八九十', cast(floor(seq / 11.0) as int) % 10 + 1, 1), '、主要会计数据')
       when seq % 7 = 0 then '（一）货币资金'
       when seq % 5 = 0 then '2、应收账款'
       when seq % 13 = 0 then '单位：万元 币种：人民币'
       when seq % 17 = 0 then '资产负债表摘要说明'
       else line end as content
from {fx_lines}"""
#: Documents whose sentences are Chinese, with figures, connectives and report words among them.
TEXTS = """select doc_id, replace(replace(replace(text, '. ', concat('。因此', cast(2010 + doc_id % 12 as varchar(9)), '年营业收入与净利润增加，')), ', ', '，但是应收账款为1200.5万元；'), ' the ', '货币资金，') as content
from {documents} where text is not null"""
STATEMENT = """select o_custkey % 200 as source_id, cast(extract(year from o_orderdate) as int) as period,
  case o_orderkey % 12 when 0 then '合同负债' when 1 then '预收款项' when 2 then '应收票据' when 3 then '应收款项融资'
    when 4 then '租赁负债' when 5 then '长期应付款' when 6 then '货币资金' when 7 then '拆出资金' when 8 then '资产减值损失'
    when 9 then '信用减值损失' when 10 then '研发费用' else '存货' end as subject,
  o_totalprice as amount, o_orderkey as line_no from {orders}"""
BOXES = """select l_orderkey % 500 as page_id, l_orderkey as okey, l_linenumber as lno, l_quantity * 10 as x0, cast(l_linenumber * 40.0 as double) as y0,
  l_quantity * 10 + 30 + l_tax * 1000 as x1, cast(l_linenumber * 40.0 + 20 as double) + l_discount * 400 as y1, l_extendedprice / 100000 as quality from {lineitem}"""
FILENAMES = """select c_custkey, concat('2020-01-', lpad(cast(1 + c_custkey % 28 as varchar(9)), 2, '0'), '__海岳', cast(c_custkey as varchar(9)), '科技股份有限公司__',
  lpad(cast(c_custkey as varchar(9)), 6, '0'), '__海岳__', cast(2015 + c_custkey % 8 as varchar(9)), '年__',
  case c_custkey % 3 when 0 then '年度报告' when 1 then '半年度报告' else '第一季度报告' end, '.pdf') as display_name from {customer}"""
PAGES = "select l_orderkey % 300 as pdf_id, l_orderkey as okey, l_linenumber as page_no, cast(l_quantity * 3 as int) as text_chars, l_discount * 10 as image_ratio from {lineitem}"
DISCLOSURE = """select doc_id, 1 as seq, cast(2015 + doc_id % 9 as int) as fiscal_year, case doc_id % 6 when 0 then '公司自2020年1月1日起执行新收入准则' when 1 then '公司暂不执行新租赁准则'
  when 2 then '已执行新金融工具确认和计量准则' when 3 then '合同负债 | 100 | 200' when 4 then '可供出售金融资产 | 1 | 2' else text end as content, case when doc_id % 6 in (3,4) then 'table' else 'text' end as element_type from {documents}"""
#: One line of a table for each source and subject: the subject under a number or an indent, and its sums in two halves of the years, in whole units.
TABLE_LINES = """select source_id as table_id, cast(row_number() over (partition by source_id order by subject) - 1 as int) as line_no,
  concat(case when length(subject) > 4 then '  ' when subject < '应' then '一、' else '' end, subject, ' | ', cast(a as varchar(20)), ' | ', cast(b as varchar(20)), case when a % 3 = 0 then '%' else '' end) as line, subject
from (select source_id, subject, sum(case when period < 1995 then cast(floor(amount) as bigint) else 0 end) as a, sum(case when period < 1995 then 0 else cast(floor(amount) as bigint) end) as b from {fx_statement} group by source_id, subject)"""
#: Lines of documents with page marks and running heads among them.
MARKED = """select doc_id, seq, case seq % 6 when 0 then concat(line, chr(10), 'page ', cast(seq as varchar(9)), ' of 10') when 1 then concat('第 ', cast(seq as varchar(9)), ' 页 / 共 10 页', chr(10), line)
  when 2 then concat(line, chr(10), cast(seq as varchar(9)), '/10', chr(10), '- ', cast(seq as varchar(9)), ' -') when 3 then concat('2019年年度报告全文', chr(10), line) else line end as content from {fx_lines}"""
#: Documents with dates of all four forms behind the text, and of a form of lower rank before some.
DATED = """select doc_id, concat(case when doc_id % 3 = 0 then '1999-12-1 ' else '' end, text, ' 报告日 ',
  case doc_id % 5 when 0 then concat(cast(2010 + doc_id % 12 as varchar(9)), ' 年 ', cast(1 + doc_id % 12 as varchar(9)), '月31日至2024年3月1日') when 1 then concat('2023.', cast(1 + doc_id % 12 as varchar(9)), '.30和2024.3.31')
    when 2 then concat('2023/12/', cast(1 + doc_id % 28 as varchar(9))) when 3 then concat('2022-', cast(1 + doc_id % 12 as varchar(9)), '-15') else '' end, '。') as content from {documents} where text is not null"""
_BASE = {"fx_dated": DATED, "fx_elements": ELEMENTS, "fx_texts": TEXTS, "fx_statement": STATEMENT, "fx_boxes": BOXES, "fx_filenames": FILENAMES, "fx_pages": PAGES, "fx_disclosure": DISCLOSURE, "fx_table_lines": TABLE_LINES, "fx_marked": MARKED}
TABLES = ("documents", "orders", "lineitem", "customer", "embeddings", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = LINES["spark"] if name == "fx_lines" else _BASE[name]
    needed = [t for t in (*TABLES, "fx_lines", "fx_statement") if "{" + t + "}" in text]
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in needed})


def sql(body: str) -> str:
    """DuckDB SQL: ``body`` after the derived tables that it names."""
    known = {"fx_lines": LINES["duckdb"], **_BASE}
    want: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name in text and name not in want:
                need(known[name])
                if name not in want:
                    want.append(name)

    need(body)
    ctes = []
    for name in want:
        text = known[name]
        for t in (*TABLES, *known):
            text = text.replace("{" + t + "}", t)
        ctes.append(f"{name} AS ({text})")
    rest = body.strip()
    if rest[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {', '.join(ctes + [''])}{rest[14:]}" if ctes else rest
    if rest[:4].upper() == "WITH":
        return f"WITH {', '.join(ctes + [''])}{rest[4:]}"
    return f"WITH {', '.join(ctes)} {rest}" if ctes else rest


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(table_id, content)``: the lines of each table below its header line."""
    lines = load(spark, sf_dir, "fx_table_lines")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("table_id").agg(F.concat(F.lit("项目 | 期初 | 期末\n"), body).alias("content"))


TABLE_TEXTS = "SELECT table_id, '项目 | 期初 | 期末' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS content FROM fx_table_lines GROUP BY table_id"
