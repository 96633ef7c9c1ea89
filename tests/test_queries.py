"""Every query of the library against its SQL, on the smallest tables."""

import oracle
import pytest

import __spark_entry__
from quillspark.plans import queries

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", [n for n in NAMES if n in queries.oracle_sql()])
def test_query_matches_sql(spark, data, con, name):
    oracle.check(con, queries.queries()[name](spark, data), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in queries.oracle_sql()])
def test_query_gives_rows(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "parents", "children", "pages", "high", "medium", "low", "avg_children"]
    assert df.count() > 0


def test_fiscal_dates_of_the_whole_text(spark, data, tmp_path):
    spark.createDataFrame([(1, "x" * 60 + "2020年1月2日")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.value for r in queries.queries()["fiscal_dates"](spark, str(tmp_path)).collect()] == ["2024-3-31,2023-12-1,2020-1-2"]
    got = {r.doc_id: r.value for r in queries.queries()["fiscal_dates_all"](spark, data).collect()}
    assert {got.get(k, "").count("-") // 2 for k in got} >= {0, 1, 2}
    assert all(v.startswith({0: str(2010 + k % 12), 1: "2023", 2: "2023-12", 3: ("1999", "2022")}.get(k % 5, ("1999", ""))) for k, v in got.items())


def test_every_box_takes_part(spark, data):
    boxes = [r.asDict() for r in queries.fx(spark, data, "fx_boxes").collect()]
    pages = {}
    for b in boxes:
        pages.setdefault(b["okey"] // 32, []).append(b)
    touch = lambda a, b: not (a["x1"] < b["x0"] or b["x1"] < a["x0"] or a["y1"] < b["y0"] or b["y1"] < a["y0"])
    want = sorted((p, a["okey"], a["lno"]) for p, on in pages.items() for a in on if a["lno"] % 2 == 1 and not any(b["lno"] % 2 == 0 and touch(a, b) for b in on))
    got = sorted((r.page_id, r.okey, r.lno) for r in queries.queries()["bbox_anti_overlap_all"](spark, data).collect())
    assert got == want and 0 < len(want) < sum(b["lno"] % 2 for b in boxes)


def test_odd_texts_give_the_boxes_of_the_sql(spark, tmp_path):
    texts = ["", " \n \t", "\n", "\x0b\n\x0c", "　\xa0", "ab\n\n cd ", "字" * 80, "a\n" * 50, "x\r\ny\r\n", None]
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(folder))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    oracle.check(con, queries.queries()["bbox_estimate"](spark, str(tmp_path)), queries.oracle_sql()["bbox_estimate"])
