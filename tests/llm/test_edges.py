"""The same awkward rows for every operator: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, decontaminate, language, line_dedup, lm_score, mixture, near_dup, suffix_dedup, topk, toxicity

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank "
LONG = " ".join(f"w{i * 7919 % 1000003}" for i in range(200_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, PROSE * 4, "en", "a", 1),
        (1, PROSE * 4, "en", "a", 1),
        (2, PROSE * 4, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "de", "b", 0),
        (None, PROSE * 4, "en", "a", 3),
        (5, " \n\t\n ", "en", "b", 5),
        (6, LONG, "en", "b", len(LONG)),
        (7, "?!? ### \x00 \U0001f600", "fr", "b", 9),
        (8, "Ünïcödé İSTANBUL straße ﬁ", "de", "b", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("x") for c in ("line", "line_no", "drops", "shard", "h", "n_lines", "pred_lang", "copies", "n_leaks", "group_id", "keep", "sig", "root", "u", "v", "key", "bucket", "__key", "wanted", "anchor", "word", "inside", "toxic_score")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (6, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


def none(df):
    return df.where(F.lit(False))


def test_toxicity(odd, labels):
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == 10
    assert all(r.toxic_score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert toxicity.toxicity(none(odd), labels).count() == 0
    assert toxicity.toxicity(odd, none(labels)).count() == 10
    assert toxicity.toxicity(odd).count() == 10
    names = toxicity.toxicity(odd.withColumn("doc_id", F.col("doc_id").cast("string")), threshold=0.0, training_documents=4, features=2).collect()
    assert all(r.is_toxic for r in names) and {r.doc_id for r in names} == {None, *"12345678"}
    assert len({r.toxic_score for r in names if r.doc_id in (None, "1", "2")}) == 1


def test_line_dedup(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed", "n_left"]
    by = {(r.doc_id, r.n_removed, r.text) for r in got.collect()}
    assert (1, 0, PROSE * 4) in by and (2, 1, "") in by and (None, 1, "") in by
    assert (3, 0, None) in by and (5, 0, " \n\t\n ") in by and (6, 0, LONG) in by
    assert line_dedup.dedup_lines(none(odd)).count() == 0


def test_language(odd):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert got[3].pred_lang == got[4].pred_lang == got[5].pred_lang == "und" and not got[3].lang_kept
    assert language.identify(none(odd)).count() == 0
    assert len({(r.pred_lang, r.lang_score) for r in language.identify(odd).where("doc_id is null or doc_id < 3").collect()}) == 1
    ties = language.identify(odd.where("doc_id < 3").withColumn("lang", F.lit("xx")).union(odd.where("doc_id < 3").withColumn("lang", F.lit("aa"))), min_lead=0.0)
    assert {r.pred_lang for r in ties.collect()} == {"aa"}
    unlabelled = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.pred_lang for r in unlabelled} == {"und"}


def test_mixture(odd, labels):
    got = mixture.mixture_plan(odd, labels).collect()
    assert {r.doc_id for r in got} <= {1, 2, 6, 7, 8} and len({r.doc_id for r in got}) == len(got)
    assert mixture.mixture_plan(none(odd), labels).count() == 0
    assert mixture.mixture_plan(odd, none(labels)).count() > 0
    assert mixture.mixture_plan(odd, labels, weights={}).count() == 0
    assert mixture.mixture_plan(odd, labels, weights={"nowhere": 1.0}).count() == 0
    only = mixture.mixture_plan(odd, labels, weights={"": 1.0}, budget=200).collect()
    assert [(r.doc_id, r.source, r.copies) for r in only] == [(2, "", 2)]
    assert "copies" in mixture.mix_sources(odd, labels).columns


def test_chat(spark):
    log = [(1, 0, "message", 0, None, "hi"), (1, 0, "message", 0, None, "hi"), (1, 1, "delta", 1, "bot", None), (None, 1, "message", 0, "u", "x"), (2, None, "message", 0, "u", "x"), (3, 0, "message", 0, "u", None), (4, 0, "nonsense", 0, "u", "x"), (5, 0, None, 0, "u", "x"), (6, 0, "message", None, "u", "x"), (7, 0, "message", 0, "u", LONG)]
    df = spark.createDataFrame(log, "conv_id long, seq long, event string, message long, role string, text string").withColumn("chat", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 7} and got[1].chat == "<|unknown|>\nhi<|end|>" and len(got[7].chat) > len(LONG)
    assert chat.format_chats(none(df)).count() == 0


def test_topk(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [5.0, 5.0]), (4, [float("nan"), 1.0]), (5, None), (None, [0.0, 1.0]), (6, [1.0]), (7, [None, 1.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted((r.id, r.rank, r.neighbour) for r in topk.nearest(df, df, 5).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    assert topk.nearest(none(df), none(df)).count() == 0
    assert topk.nearest(df, df.where("vec_id = 1").limit(1)).where("id = 1").count() == 0


def test_lm_score(odd, labels):
    got = lm_score.lm_scores(odd, labels.where("quality = 1")).collect()
    assert len(got) == 10
    assert [r.lm_score for r in got if r.doc_id == 3] == [None] and [r.lm_score for r in got if r.doc_id == 4] == [0.0]
    assert lm_score.lm_scores(odd, none(labels)).count() == 10
    assert len({r.lm_score for r in got if r.doc_id in (None, 1, 2)}) == 1 and [r.n_bytes for r in got if r.doc_id == 6] == [len(LONG)]
    assert lm_score.lm_scores(none(odd), labels).count() == 0


def test_near_dup(odd):
    got = sorted((r.doc_id, r.group_id, r.keep) for r in near_dup.near_groups(odd).collect())
    assert got == [(1, 1, True), (2, 1, False)]
    kept = near_dup.dedup_near(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert near_dup.near_groups(none(odd)).count() == 0


def test_suffix_dedup(odd):
    n = len((PROSE * 4).split())
    own = len(PROSE.split())
    got = sorted((r.doc_id, r.start_word, r.n_words, r.keep) for r in suffix_dedup.repeated_spans(odd).collect())
    assert got == [(1, 0, own + 49, True), (1, own, n - own, False), (2, 0, n, False)] and not any(d in (6, 7, 8) for d, *_ in got)
    assert sorted(r.doc_id for r in suffix_dedup.repeated_spans(odd.where("doc_id = 1"), inside=True).where("keep").collect()) == [1]
    assert suffix_dedup.repeated_spans(odd.where("doc_id = 1")).count() == 0
    assert suffix_dedup.repeated_spans(none(odd)).count() == 0
    cut = suffix_dedup.remove_repeats(odd)
    assert cut.columns == [*odd.columns, "n_spans"] and cut.count() == 10
    assert {r.text for r in cut.where("doc_id in (3, 4, 6)").collect()} == {None, "", LONG}
    assert suffix_dedup.remove_repeats(none(odd)).count() == 0


def test_decontaminate(spark, odd):
    bench = spark.createDataFrame([(1, "over the lazy dog while seven wise owls watch from an old oak tree"), (2, None), (None, "x"), (3, ""), (4, "…")], "item_id long, text string")
    got = decontaminate.leaks(odd, bench).collect()
    assert {r.doc_id for r in got} == {1, 2, None} and {r.item_id for r in got} == {1}
    clean = decontaminate.remove_leaks(odd, bench)
    rows = {(r.doc_id, r.n_leaks) for r in clean.collect()}
    assert rows == {(1, 4), (2, 4), (3, 0), (4, 0), (None, 4), (5, 0), (6, 0), (7, 0), (8, 0)}
    assert {r.text for r in clean.where("doc_id in (3, 6)").collect()} == {None, LONG}
    assert decontaminate.leaks(odd, none(bench)).count() == 0 and decontaminate.remove_leaks(odd, none(bench)).count() == 10
    assert decontaminate.leaks(none(odd), bench).count() == 0


def test_pipeline_stages(spark, odd, tmp_path):
    docs = odd
    spark.createDataFrame([(1, "some test item of several words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs, none(docs)):
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            df = f(spark, df, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert sorted(df.columns) == sorted(docs.columns), name
        rows = df.collect()
        assert {r.doc_id for r in rows} <= {1, 6, 7, 8} and all(r.text.strip() for r in rows)
