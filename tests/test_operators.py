"""Operators over tables: golden cases, brute force and edge cases."""

import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunks, context, elements, folds, standards, windows
from quillspark.plans import assembly
from quillspark.sources import chunk_json, elements as readers, files
from quillspark.streaming import incremental


def test_page_ranges(spark):
    pages = spark.createDataFrame([(1, p) for p in [1, 2, 3, 5, 6, 7, 7, 100, 101, None]], "doc int, page int")
    got = sorted((r.first_page, r.last_page) for r in chunks.page_ranges(pages, "doc").collect())
    assert got == [(1, 3), (5, 7), (100, 101)]


def test_windows_cover_and_advance():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abc 。.!\n字") for _ in range(rng.randint(0, 6000)))
        spans = list(windows.child_spans(text, 300, 50, 1))
        assert all(a < b for a, b in spans)
        assert all(x[0] < y[0] and y[1] > x[1] for x, y in zip(spans, spans[1:], strict=False))
        seen = set().union(*(range(a, b) for a, b in spans)) if spans else set()
        assert not [c for i, c in enumerate(text) if i not in seen and c not in " \n\t"] or spans


def test_windows_refuse_to_stand_still(spark):
    with pytest.raises(ValueError):
        windows.child_windows(spark.createDataFrame([("x",)], "text string"), size=100, overlap=50)


def test_windows_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "好" * 60)], "doc_id int, text string")
    assert [(r.doc_id, r.position, r.start_char, r.end_char) for r in windows.child_windows(df).collect()] == [(4, 0, 0, 60)]


def _elements(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, seq int, page_number int, element_type string, content string")


def test_groups(spark):
    e = _elements(spark, [(1, 0, 1, "text", "甲"), (1, 1, 1, "text", "一、乙"), (1, 2, 1, "text", "丙"), (1, 3, 3, "text", "丁"), (1, 4, 3, "title", "戊"), (1, 5, 3, "text", None)])
    got = [(r.group_no, r.first_seq, r.last_seq) for r in folds.semantic_groups(e).orderBy("group_no").collect()]
    assert got == [(0, 0, 0), (1, 1, 2), (2, 3, 3), (3, 4, 5)]
    assert folds.semantic_groups(e.where("false")).count() == 0


def test_paragraphs_merge(spark):
    e = _elements(
        spark,
        [(1, 0, 1, "text", "公司的收入"), (1, 1, 2, "text", "增加了。"), (1, 2, 2, "text", "另一段"), (1, 3, 2, "title", "（一）标题"), (1, 4, 2, "text", "inter-"), (1, 5, 3, "text", "national"), (1, 6, 9, "text", "far")],
    )
    got = [(r.seq, r.pages, r.content) for r in folds.merge_paragraphs(e).orderBy("seq").collect()]
    assert got == [(0, [1, 2], "公司的收入增加了。"), (2, [2], "另一段"), (3, [2], "（一）标题"), (4, [2, 3], "international"), (6, [9], "far")]


def test_merge_looks_at_the_first_page_of_a_paragraph(spark):
    e = _elements(spark, [(1, 0, 1, "text", "甲"), (1, 1, 2, "text", "乙"), (1, 2, 3, "text", "丙")])
    assert [(r.seq, r.content) for r in folds.merge_paragraphs(e).orderBy("seq").collect()] == [(0, "甲乙"), (2, "丙")]


def test_large_groups(spark):
    e = spark.createDataFrame([(1, 0, i, "字" * 30) for i in range(4)], "doc_id int, group_no int, seq int, content string")
    assert sorted((r.part_no, r.n_elements) for r in folds.split_large_groups(e, 70).collect()) == [(0, 2), (1, 2)]
    # 120 characters and three separators are too large for 125 though their sum is not
    assert sorted((r.part_no, r.n_elements) for r in folds.split_large_groups(e, 125).collect()) == [(0, 4)]


def test_table_lines(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a" * 6, "b" * 20, "c", "d" * 9])], "table_id int, line_no int, line string")
    assert [r.content for r in folds.split_table_by_size(lines, 10, drop_large=True).orderBy("part_no").collect()] == ["a" * 6, "c\n" + "d" * 9]
    whole = [r.content for r in folds.split_table_by_size(lines, 10).orderBy("part_no").collect()]
    assert sorted("\n".join(whole).split("\n")) == sorted(r.line for r in lines.collect())


def test_row_paths(spark):
    cells = ["一、流动资产", "  货币资金", "  （一）存货", "1,200", "", "二、负债"]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(cells)], "table_id int, row_no int, cell string")
    got = [r.path for r in folds.row_paths(rows).orderBy("row_no").collect()]
    assert got == ["流动资产", "货币资金", "货币资金 / 存货", "货币资金 / 存货", "货币资金 / 存货", "负债"]


def test_boxes(spark):
    b = spark.createDataFrame([(1, 1, False, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 2, True, 0.0, 0.0, 10.0, 9.0, 0.9), (1, 3, True, 50.0, 0.0, 60.0, 10.0, 0.1), (1, 4, True, 0.0, 0.0, 10.0, 9.5, 0.2)], "page_id int, ord int, fresh boolean, x0 double, y0 double, x1 double, y1 double, quality double")
    assert sorted(r.ord for r in folds.merge_boxes(b).collect()) == [2, 3]
    texts = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 20.0), (1, 2, 10.1, 10.1, 20.0, 20.0), (2, 3, 0.0, 0.0, 1.0, 1.0), (1, 4, None, None, None, None)], "page_id int, t int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.t for r in context.outside_tables(texts, b.where("ord = 1")).collect()) == [2, 3, 4]


def test_context_serves_one_table_only(spark):
    rows = [(1, 0, 1, "text", "七、主要会计数据表"), (1, 1, 1, "text", "单位：元"), (1, 2, 1, "table", "a|b"), (1, 3, 1, "text", "注：已审计"), (1, 4, 1, "table", "c|d")]
    got = {r.table_seq: (r.title_seq, r.note_seq, r.caption_seq) for r in context.contexts(_elements(spark, rows)).collect()}
    assert got[2] == (0, 3, 1)
    assert got[4] == (None, None, None)


def test_sections_by_a_stack(spark):
    rng = random.Random(5)
    heads = {1: "第一章 总", 2: "一、二级", 3: "（一）三级", 4: "1、四级", 0: "正文"}
    rows = [(d, s, heads[rng.randint(0, 4)]) for d in range(30) for s in range(25)]
    got = {(r.doc_id, r.seq): (r.section_level, r.section_seq) for r in elements.section_tree(spark.createDataFrame(rows, "doc_id int, seq int, content string")).collect()}
    for d in range(30):
        stack = {}
        for _, s, c in (r for r in rows if r[0] == d):
            level = next(k for k, v in heads.items() if v == c)
            if level:
                stack = {k: v for k, v in stack.items() if k < level} | {level: s}
            want = (max(stack), stack[max(stack)]) if stack else (0, None)
            assert got[d, s] == want


def test_overlaps_by_brute_force(spark):
    rng = random.Random(9)
    spans = [(k, i, a := rng.randint(0, 500), a + rng.randint(0, 60)) for k in range(4) for i in range(40)]
    got = {(r.doc, r.a, r.b) for r in chunks.overlapping(spark.createDataFrame(spans, "doc int, pos int, start int, end int"), "doc").collect()}
    want = set()
    for k, i, a, b in spans:
        for k2, j, c, d in spans:
            if k == k2 and i < j and min(b, d) > max(a, c) and (min(b, d) - max(a, c)) / min(b - a, d - c) > 0.1:
                want.add((k, i, j))
    assert got == want and want


def test_standards(spark):
    rows = [
        (1, 1, 2016, "text", "x"),
        (2, 1, 2022, "text", "x"),
        (3, 1, 2019, "text", "公司自2020年1月1日起执行企业会计准则第14号"),
        (4, 1, 2019, "text", "暂不执行新租赁准则"),
        (5, 1, 2018, "table", "合同负债|使用权资产"),
        (6, 1, None, "text", "x"),
        (7, 1, 2020, "text", "x"),
        (8, 1, 2020, "text", "已执行新收入准则、新金融工具准则、新租赁准则"),
    ]
    got = {r.doc_id: (r.revenue, r.financial_instruments, r.lease, r.decided_by) for r in standards.profiles(spark.createDataFrame(rows, "doc_id int, seq int, fiscal_year int, element_type string, content string")).collect()}
    assert got[1] == ("old", "old", "old", "default_before_transition")
    assert got[2] == ("new", "new", "new", "default_after_transition")
    assert got[3] == ("old", "new", "old", "table_keywords_with_year_fallback")
    assert got[4] == ("new", "new", "old", "table_keywords_with_year_fallback")
    assert got[5] == ("new", "old", "new", "table_keywords_with_year_fallback")
    assert got[6] == ("unknown", "unknown", "unknown", "unknown")
    assert got[7] == ("new", "new", "old", "year_threshold")
    assert got[8] == ("new", "new", "new", "explicit_note")


def test_metrics(spark):
    values = spark.createDataFrame([(1, 2018, "合同负债", 5.0), (2, 2018, "预收款项", 0.0), (2, 2018, "合同负债", 7.0), (3, 2018, "存货", 1.0)], "doc_id int, period int, subject string, amount double")
    profile = spark.createDataFrame([(1, "old", "new", "new"), (2, "old", "new", "new")], "doc_id int, revenue string, financial_instruments string, lease string")
    got = {(r.doc_id, r.metric): (r.value, r.subjects_used, r.standard_used) for r in standards.metrics(values, profile).collect()}
    assert got[1, "contract_liabilities_like"] == (5.0, "合同负债", "new_fallback")
    assert got[2, "contract_liabilities_like"] == (0.0, "", "old")
    assert got[3, "contract_assets_like"] == (1.0, "存货", "old_fallback")
    assert got[3, "rd_expenses"] == (0.0, "", "new")
    assert len(got) == 33


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_text("一\n\n# 注释\n 二 \n")
    assert files.scan(spark, [str(tmp_path), "/no/such/folder"]).count() == 1
    assert files.scan(spark, ["/no/such/folder"]).count() == 0
    assert [r.name for r in files.name_list(spark, str(tmp_path / "b.txt")).orderBy("ord").collect()] == ["一", "二"]
    assert [r.name for r in files.names_of(spark, "a, ,b").collect()] == ["a", "b"]
    found = files.resolve(spark.createDataFrame([(0, "a"), (1, "x/y.pdf"), (2, "z")], "ord int, name string"), spark.createDataFrame([(0, "d"), (1, "e")], "dir_ord int, dir string"), spark.createDataFrame([("e/a",), ("d/a.pdf",), ("x/y.pdf",)], "path string"))
    assert sorted((r.ord, r.path) for r in found.collect()) == [(0, "d/a.pdf"), (1, "x/y.pdf")]


def test_readers(spark, tmp_path):
    (tmp_path / "r.txt").write_text("第一章 总则与范围说明\n\n这是第一段，足够长的一段文字。\f第二页的一段文字在这里，也够长。")
    got = readers.read(spark, "text", str(tmp_path / "r.txt")).orderBy("seq").collect()
    assert [(r.seq, r.page_number, r.element_type) for r in got] == [(0, 1, "title"), (1, 1, "text"), (2, 2, "text")]
    with pytest.raises(ValueError, match="register"):
        readers.read(spark, "pdfplumber", "x")
    with pytest.raises(ValueError, match="no reader"):
        readers.read(spark, "nothing", "x")


def test_json_keeps_nulls(spark, tmp_path):
    p = spark.createDataFrame([("s", 0, "内容", None)], "source_ref string, seq int, content string, section string")
    k = spark.createDataFrame([("s", 1, "乙"), ("s", 0, "甲")], "source_ref string, seq int, content string")
    docs = chunk_json.documents(p, k, spark.createDataFrame([("s", 3)], "source_ref string, chars int"))
    assert '"section":null' in docs.first()["json"]
    chunk_json.write_json(docs, str(tmp_path / "out"))
    back = chunk_json.read_chunks(spark, str(tmp_path / "out"), "children", "seq int, content string")
    assert [(r.seq, r.content) for r in back.orderBy("seq").collect()] == [(0, "甲"), (1, "乙")]


def test_chunk_documents(spark):
    rows = [(1, 0, 1, "第一章 公司简介"), (1, 1, 1, "一、主要会计数据"), (1, 2, 1, "单位：万元"), (1, 3, 1, "项目|2019|2018\n收入|1,200|1,100\n成本|800|700"), (1, 4, 2, "本公司本年度营业收入与净利润均有所增加，主要原因是产品销量上升，成本下降，因此毛利率提高。" * 40)]
    raw = spark.createDataFrame(rows, "doc_id int, seq int, page_number int, content string")
    parents, children, groups = assembly.chunk_documents(raw)
    g = groups.collect()
    assert len(g) == 1 and g[0].title_seq == 1 and g[0].caption_seq == 2 and "【标题】一、主要会计数据" in g[0].unified
    p = {r.chunk_id: r for r in parents.collect()}
    kids = children.collect()
    assert kids and all(k.chunk_id in p[k.parent_id].child_ids for k in kids if k.parent_id in p)
    assert all(k.chunk_id not in k.sibling_ids for k in kids)


def test_chunk_documents_has_every_branch(spark):
    """A document with sections, an important table split by its items, a plain one in one child, text before and after, and a file name."""
    rows = [
        "第一章 公司简介",
        "本公司本年度营业收入与净利润均有所增加，主要原因是产品销量上升，成本下降，因此毛利率提高。" * 3,
        "一、合并资产负债表",
        "单位：万元",
        "项目|2019年|2018年\n货币资金|1,200|1,100\n" + "\n".join(f"明细{k}|{k},000|{k},100" for k in range(1, 9)) + "\n应收账款|800|700\n存货|80|70",
        "一、主要会计数据",
        "本期应收账款增加，说明客户的回款变慢，公司已采取措施。" * 5,
        "名称|数量|备注\n" + "\n".join(f"件{k}|{k}0|无" for k in range(1, 9)),
    ]
    raw = spark.createDataFrame([(1, k, k // 3 + 1, c) for k, c in enumerate(rows)], "doc_id int, seq int, page_number int, content string")
    names = spark.createDataFrame([(1, "2020-04-01__海岳科技股份有限公司__600001__海岳__2019年__年度报告.pdf")], "doc_id int, display_name string")
    parents, children, groups = (df.collect() for df in assembly.chunk_documents(raw, assembly.Options(child_size=300, overlap=50, least_size=10, least_quality=0.0), names))
    assert len(groups) == 2
    nodes = [r for r in parents if r.chunk_type == "section"]
    assert {r.section_title for r in nodes} >= {"公司简介"} or any("公司简介" in r.section_title for r in nodes)
    made = [r for r in parents if r.chunk_type != "section"]
    assert all(r.company_code == "600001" and r.fiscal_year == 2019 and r.report_type == "年度报告" for r in made)
    assert all(r.page_numbers and 0 <= r.confidence <= 1 for r in made)
    tabled = {r.chunk_id: r for r in made if r.chunk_type == "table_group"}
    assert len(tabled) == 2
    kids = {k: [c for c in children if c.parent_id == k] for k in tabled}
    important = next(k for k, r in tabled.items() if "货币资金" in r.content)
    assert len(kids[important]) > 1 and len(kids[next(k for k in tabled if k != important)]) == 1
    text = [r for r in made if r.chunk_type == "text"]
    assert text and all(any(c.parent_id == r.chunk_id for c in children) for r in text if len(r.content) >= 50)
    for strategy in ("sliding", "fixed"):
        p, c, _ = assembly.chunk_documents(raw, assembly.Options(strategy=strategy, parent_size=200, child_size=100, overlap=20, least_size=1, least_quality=0.0))
        body = [r.content for r in p.where("chunk_type = 'text'").orderBy("seq").collect()]
        assert len(body) > 1 and max(map(len, body)) <= 200 and c.count() > len(body)


def test_large_groups_are_split_again(spark):
    rows = [(1, "s", k, 1, [1], "text", "字" * 99) for k in range(5)]
    rest = spark.createDataFrame(rows, "doc_id int, section string, seq int, page_number int, pages array<int>, element_type string, content string")
    got = sorted((r.group_no, r.part_no, r.first_seq, r.n_elements, len(r.content)) for r in assembly.semantic_parents(rest, 200).collect())
    assert [g[4] for g in got] == [99] * 5 or all(g[4] <= 202 for g in got)
    assert sum(g[3] for g in got) == 5


def test_duplicates_with_tied_and_null_orders(spark):
    rows = [(0, "B"), (1, "A"), (1, "B"), (None, "C"), (None, "C"), (2, None), (3, "")]
    got = sorted((r.k is None, r.k or 0, r.c or "") for r in chunks.deduplicate(spark.createDataFrame(rows, "k int, c string"), "c", "k").collect())
    assert got == [(False, 0, "B"), (False, 1, "A"), (False, 2, ""), (True, 0, "C")]


def test_elements_without_page_stay(spark):
    rows = [(1, 0, None, "text", "开头"), (1, 1, 2, "text", "继续。"), (1, 2, None, "text", "又一段"), (1, 3, 3, "text", "完")]
    got = folds.merge_paragraphs(spark.createDataFrame(rows, "doc_id int, seq int, page_number int, element_type string, content string")).orderBy("seq").collect()
    assert "".join(r.content for r in got) == "开头继续。又一段完" and [r.seq for r in got] == [0, 2]


def test_options():
    o = assembly.Options.of({"child_size": 1, "chunking": {"child_size": 900, "unknown": 1}})
    assert o.child_size == 900 and o.parent_size == 4000


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write = lambda k: spark.createDataFrame([(k, "一段文字。" * 30)], "doc_id int, text string").write.mode("append").parquet(src)
    for k in (1, 2):
        write(k)
        stream = incremental.chunked(incremental.elements(spark, src, "doc_id int, text string"))
        incremental.run(stream, out, mark).awaitTermination(120)
        assert spark.read.parquet(out).select("doc_id").distinct().count() == k
    n = spark.read.parquet(out).count()
    incremental.run(incremental.chunked(incremental.elements(spark, src, "doc_id int, text string")), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == n


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda h: datetime(2024, 1, 1, h)
    for rows in ([(t(1), 0.5), (t(5), 0.5)], [(t(1), 0.5), (t(6), 0.5)]):
        spark.createDataFrame(rows, "at timestamp, quality double").coalesce(1).write.mode("append").parquet(src)
        q = incremental.arrivals(incremental.elements(spark, src, "at timestamp, quality double", 1), "at").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.window.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[t(1)] == 1


def test_empty_tables(spark):
    e = _elements(spark, []).withColumn("text", F.col("content"))
    assert folds.merge_paragraphs(e).count() == 0
    assert context.contexts(e).count() == 0
    assert elements.section_tree(e).count() == 0
    assert windows.child_windows(e.select("doc_id", "text")).count() == 0


def _merged_by_brute_force(fresh, boxes, quality, threshold):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = w * h if w > 0 and h > 0 else 0.0
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0.0

    kept = []
    for i, box in enumerate(boxes):
        same = next((j for j, k in enumerate(kept) if iou(boxes[k], box) > threshold), None) if fresh[i] else None
        if same is None:
            kept.append(i)
        elif quality[i] > quality[kept[same]]:
            kept[same] = i
    return kept


def test_merged_boxes_by_brute_force(monkeypatch):
    rng = random.Random(4)
    for trial in range(120):
        monkeypatch.setattr(folds, "_REMEMBERED", (0, 50, 8_000_000)[trial % 3])
        n, step = rng.choice([1, 40, 150]), rng.choice([1, 7, 0.1])
        side = (lambda: rng.randint(0, 10) * step) if trial % 2 else rng.random
        corners = [(side() - 5 * step * (trial % 5 == 0), side()) for _ in range(n)]
        boxes = [(x, y, x + side(), y + side() * rng.choice([1, 5])) for x, y in corners]
        fresh, quality = [rng.random() < 0.6 for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        threshold = rng.choice([0.55, 0.1, 0.0, 0.9])
        assert folds.merged_rows(np.array(fresh), np.array(boxes, float), np.array(quality, float), threshold) == _merged_by_brute_force(fresh, boxes, quality, threshold)


def test_merged_boxes_of_a_large_page():
    # 60,000 boxes of 20,000 places that do not meet: each compared with all kept before it takes a thousand million comparisons
    n = 60_000
    k = np.arange(n) % 20_000
    x, y = (k % 200) * 10.0, (k // 200) * 10.0
    began = time.perf_counter()
    kept = folds.merged_rows(np.arange(n) >= 20_000, np.column_stack([x, y, x + 9, y + 9]), np.arange(n) // 20_000, 0.55)
    assert kept == list(range(40_000, 60_000)) and time.perf_counter() - began < 60


def test_boxes_without_coordinates_or_page(spark):
    rows = [(1, 1, False, None, 0.0, 10.0, 10.0, 0.5), (1, 2, True, None, 0.0, 10.0, 10.0, None), (None, 1, False, 0.0, 0.0, 9.0, 9.0, 0.5), (None, 2, True, 0.0, 0.0, 9.0, 9.0, 0.6), (2, 1, True, 3.0, 3.0, 3.0, 9.0, 0.1), (2, 2, True, 3.0, 3.0, 3.0, 9.0, 0.2)]
    b = spark.createDataFrame(rows, "page_id int, ord int, fresh boolean, x0 double, y0 double, x1 double, y1 double, quality double")
    assert sorted(((r.page_id or 0), r.ord) for r in folds.merge_boxes(b).collect()) == [(0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_dangling_children_whose_ids_repeat(spark):
    rows = [(1, 0, "x", 0.1), (1, 1, "y", 0.9), (2, 0, "x", 0.9), (3, 0, "z", 0.9), (3, 1, "z", 0.1), (4, 0, "w", 0.1)]
    kids = spark.createDataFrame(rows, "parent_id int, position int, chunk_id string, quality double")
    got = chunks.dangling(chunks.links(kids), kids.where("quality > 0.5"))
    assert sorted((r.parent_id, r.child_id) for r in got.collect()) == [(1, "x"), (3, "z"), (4, "w")]


def test_context_looks_at_elements_near_tables_only(spark, monkeypatch):
    rng = random.Random(6)
    forms = ["七、主要会计数据表", "（一）货币资金明细表", "单位：元", "注：已审计", "净利润", "无", "", None]
    rows = [(d, k, 1 + k // 10, "table" if rng.random() < (0, 0.05, 0.3)[d % 3] else "text", rng.choice(forms)) for d in range(30) for k in range(60)]
    e, given, whole = _elements(spark, rows), [], context.described
    monkeypatch.setattr(context, "described", lambda df: given.append(df) or whole(df))
    for before, after in ((10, 3), (0, 0), (2, 5)):
        got = sorted(map(str, context.contexts(e, before, after).collect()))
        placed = whole(e.withColumn("pos", F.col("seq")))
        assert got == sorted(map(str, folds.assign_context(placed, before, after).collect())) and got
        assert given[-1].where("doc_id % 3 = 0").count() == 0 and given[-1].count() < len(rows)


def test_overlap_counts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chunks, "_FEW", 3)
    rng = random.Random(8)
    spans = [(k or None, rng.choice([None, *range(12)]), a := rng.randint(0, 400), a + rng.randint(0, 60) if rng.random() < 0.95 else None) for k in range(4) for _ in range(90)]
    got = chunks.overlap_counts(spark.createDataFrame(spans, "doc int, pos int, start int, end int"), "doc")
    real = [s for s in spans if None not in s and s[3] > s[2]]
    linked = lambda s, x: s[0] == x[0] and s[1] != x[1] and min(s[3], x[3]) > max(s[2], x[2]) and (min(s[3], x[3]) - max(s[2], x[2])) / min(s[3] - s[2], x[3] - x[2]) > 0.1
    first = lambda s: min((x[1] for x in spans if x[0] == s[0] and x[2:] == s[2:] and x[1] is not None), default=None)
    want = [(s[0], s[1], first(s), sum(linked(s, x) for x in real) if s in real else 0) for s in spans]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    # the pairs of a document give the same numbers where no pos repeats
    alone = [(1, i, a, b) for i, (_, _, a, b) in enumerate(s for s in spans if s[3] is not None)]
    df = spark.createDataFrame(alone, "doc int, pos int, start int, end int")
    pairs = [x for r in chunks.overlapping(df, "doc").collect() for x in (r.a, r.b)]
    assert {r.pos: r.links for r in chunks.overlap_counts(df, "doc").collect()} == {i: pairs.count(i) for _, i, _, _ in alone}


def test_overlap_counts_of_a_large_page():
    # each span meets all others: as pairs these would be five thousand million
    n = 100_000
    began = time.perf_counter()
    got = chunks.count_overlaps(np.zeros(n, np.int64), np.arange(1, n + 1) * 2, 0.1)
    assert (got == n).all() and time.perf_counter() - began < 30


def test_links_of_parents_whose_ids_repeat_among_documents(spark):
    kids = spark.createDataFrame([(1, "p", 0, "a"), (1, "p", 1, "b"), (2, "p", 0, "c")], "doc_id int, parent_id string, position int, chunk_id string")
    assert sorted((r.doc_id, r.child_ids) for r in chunks.links(kids, "doc_id").collect()) == [(1, ["a", "b"]), (2, ["c"])]
    assert {r.chunk_id: r.sibling_ids for r in chunks.siblings(kids, "doc_id").collect()} == {"a": ["b"], "b": ["a"], "c": []}


def test_tables_whose_ids_repeat_among_documents(spark):
    tables = [(1, "t", "table_group", "a | 1\nb | 2"), (2, "t", "table_group", "c | 3")]
    df = spark.createDataFrame(tables, "doc_id int, chunk_id string, chunk_type string, content string").selectExpr("*", "cast(null as array<string>) as items", "cast(null as array<string>) as periods")
    got = assembly.table_children(df, assembly.Options()).collect()
    assert sorted((r.doc_id, r.chunk_id, r.position, r.content) for r in got) == [(1, "t", 0, "a | 1\nb | 2"), (2, "t", 0, "c | 3")]
