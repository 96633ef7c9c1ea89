"""Every operator against brute force or on held-out data."""

import collections
import random

import numpy as np
import oracle
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, decontaminate, language, line_dedup, lm_score, mixture, near_dup, queries, suffix_dedup, textvec, topk, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


@pytest.fixture(scope="module")
def frame(docs):
    return docs.toPandas()


def words_of(texts):
    w = textvec.words(pa.array(texts, pa.string()))
    return [w.hashes[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    oracle.check(oracle.connect(data), queries.queries()[name](spark, data), queries.oracle_sql()[name])


def test_words_by_regex():
    import re

    texts = ["Hello, wörld! a1-b2", "", None, "É é", "x" * 10, "a\x00b"]
    got = textvec.words(pa.array(texts))
    want = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert np.diff(got.first).tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (got.hashes[i] == got.hashes[j]) == (a == b)


def test_suffix_array_by_sorting():
    rng = random.Random(1)
    for _ in range(400):
        t = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def _repeated(rows, inside, n=suffix_dedup.PASSAGE):
    """Spans by comparing all runs of words."""
    occurrences = collections.defaultdict(list)
    for i, h in zip([r[0] for r in rows], words_of([r[1] for r in rows]), strict=True):
        for j in range(len(h) - n + 1):
            occurrences[tuple(h[j : j + n])].append((i, j))
    starts = collections.defaultdict(set)
    for places in occurrences.values():
        if len(places) > 1 and (inside or len({i for i, _ in places}) > 1):
            for p in places:
                starts[p[0], p == min(places)].add(p[1])
    want = set()
    for (i, keep), at in starts.items():
        a = b = None
        for j in sorted(at):
            if b is None or j > b:
                want |= {(i, a, b - a, keep)} if b is not None else set()
                a, b = j, j + n
            b = max(b, j + n)
        want.add((i, a, b - a, keep))
    return want


@pytest.mark.parametrize("inside, hot", [(False, 2000), (True, 2000), (False, 2), (True, 1)])
def test_repeated_spans_by_brute_force(docs, frame, monkeypatch, inside, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {tuple(r) for r in suffix_dedup.repeated_spans(docs, inside).toPandas().itertuples(index=False)}
    assert got == _repeated(list(zip(frame.doc_id, frame.text, strict=True)), inside) and got


def test_repeats_are_cut_out(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, own = words(60), [words(55) for _ in range(6)]
    rows = [("b", f"{own[0]}, {passage}. {own[1]}"), ("a", f"{own[2]} {passage.upper()}! {own[3]}"), (None, passage), ("b", f"{own[4]} {passage}"), ("c", own[5]), ("c", own[5]), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("part", F.lit(1))
    got = sorted((r.doc_id or "", r.text, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect() if r.text is not None)
    want = sorted([("b", f"{own[0]}, {passage}. {own[1]}", 0), ("a", f"{own[2]} {passage.upper()}! {own[3]}", 0), ("", passage, 0), ("b", f"{own[4]} {passage}", 0), ("c", own[5], 0), ("c", own[5], 0), ("e", "", 0)])
    assert [g[0] for g in got] == [w[0] for w in want]
    cut = [g for g in got if g[2]]
    assert len(cut) == 3 and sum(passage in (t or "").lower() for _, t, _ in got) == 1
    rest = lambda t: " ".join(t.lower().replace(passage, "").translate(str.maketrans(",.!", "   ")).split())
    assert sorted(rest(w[1]) for w in want) == sorted(rest(g[1]) for g in got)
    assert {g[:2] for g in got if g[0] in "ce"} == {w[:2] for w in want if w[0] in "ce"}


def test_near_groups_by_brute_force(docs, frame):
    sets = {}
    for i, h in zip(frame.doc_id, words_of(frame.text.tolist()), strict=True):
        k = near_dup.SHINGLE
        sets[i] = {tuple(h[j : j + k]) for j in range(max(1, len(h) - k + 1))} if h else set()
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = collections.Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    similar = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    near = [p for p, j in similar.items() if j >= near_dup.THRESHOLD]
    group = {r.doc_id: r.group_id for r in near_dup.near_groups(docs).collect()}
    found = sum(1 for a, b in near if a in group and group[a] == group.get(b))
    assert found >= 0.9 * len(near) and len(near) > 100
    # no document is in a group without some partner that is at least nearly similar enough
    best = collections.defaultdict(float)
    for (a, b), j in similar.items():
        best[a], best[b] = max(best[a], j), max(best[b], j)
    assert all(best[i] >= near_dup.THRESHOLD - 0.2 for i in group)


def test_forest_compares_large_regions_completely():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 256, (5, 128), dtype=np.uint8)
    low = centres[rng.integers(0, 5, 300)].copy()
    noise = rng.random(low.shape) < 0.2
    low[noise] = rng.integers(0, 256, noise.sum(), dtype=np.uint8)
    comp = near_dup.link(low, 0.5)
    want = np.arange(300)
    for i in range(300):
        for j in np.flatnonzero(near_dup._similar(low[i], low) >= 0.5):
            a, b = sorted((want[i], want[j]))
            want[want == b] = a
    assert (comp == want).all() and len(set(comp)) < 20


def test_regions_of_any_size_are_compared_completely(monkeypatch):
    """Pages of one template: whoever shares two values of a tree is compared, with however many others."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    some_words = lambda n: " ".join(word() for _ in range(n))
    template = some_words(30)
    texts = []
    for _ in range(250):
        own = some_words(12)
        texts += [f"{template} {own} {some_words(18)}", f"{template} {own} {some_words(18)}"]
    some, sig = near_dup.signatures(pa.array(texts))
    signed = pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "sig"])
    rows = pa.Table.from_batches(near_dup._plant(iter([signed]))).sort_by([("root", "ascending"), ("label", "ascending"), ("doc_id", "ascending")])
    low = (sig & 0xFF).astype(np.uint8)
    want = set()
    for root in {r for r in rows.column("root").to_pylist()}:
        ids = rows.filter(pa.compute.equal(rows.column("root"), root)).column("doc_id").to_pylist()
        want |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near_dup._similar(low[a], low[b : b + 1])[0] >= near_dup.THRESHOLD}
    assert len(want) > 100
    monkeypatch.setattr(near_dup, "REGION", 4)
    group = list(range(len(texts)))
    for batch in near_dup._neighbours(iter(rows.combine_chunks().to_batches()), near_dup.THRESHOLD):
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            group = [group[b] if g == group[a] else g for g in group]
    assert all(group[a] == group[b] for a, b in want)


def test_hot_regions_give_the_same_groups(spark, docs, monkeypatch):
    some = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    want = sorted(map(tuple, near_dup.near_groups(some).collect()))
    monkeypatch.setattr(near_dup, "HOT", 3)
    assert sorted(map(tuple, near_dup.near_groups(some).collect())) == want and len(want) > 100


def test_components_by_union_find(spark):
    from quillspark.llm.graph import components

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: min(y for y in root if find(y) == find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want


def test_automaton_by_brute_force():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 20)))) for i in range(12)]
    index = decontaminate.build(items)
    sequences = {i: t.split() for i, t in items}
    runs = {tuple(s[a:b]) for s in sequences.values() for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for _ in range(60):
        text = [rng.choice("abcdefghz") for _ in range(60)]
        k = rng.randrange(12)
        text[20:20] = sequences[k][: rng.randint(6, 20)]
        w = textvec.words(pa.array([" ".join(text)]))
        got = {(s, e) for _, s, e, _, size, covered in decontaminate.matches(index, w.hashes, w.first, 8, 0.5) if covered <= e - s}
        together = [(s, e) for _, s, e, _, size, covered in decontaminate.matches(index, w.hashes, w.first, 8, 0.5) if covered > e - s]
        assert all(e - s >= decontaminate.SHORTEST and tuple(text[s:e]) in runs for s, e in together)
        want = set()
        for e in range(1, len(text) + 1):
            n = max((n for n in range(1, e + 1) if tuple(text[e - n : e]) in runs), default=0)
            if n and (e == len(text) or tuple(text[e - n : e + 1]) not in runs):
                size = min(len(s) for s in sequences.values() if any(s[a : a + n] == text[e - n : e] for a in range(len(s))))
                if n >= 8 or (n >= decontaminate.SHORTEST and n >= 0.5 * size):
                    want.add((e - n, e))
        want |= {(a, a + len(s)) for s in sequences.values() if len(s) < 8 for a in range(len(text)) if text[a : a + len(s)] == s}
        assert got <= want and want - got <= set(together)


def test_short_items_and_changed_copies(spark):
    item = [f"w{k}" for k in range(30)]
    changed = [f"x{k}" if k in (10, 20) else w for k, w in enumerate(item)]
    docs = [("short", "say one two three four now"), ("changed", "a b " + " ".join(changed) + " c"), ("phrase", " ".join(item[:7] * 4)), ("word", "word word"), ("far", " ".join([*item[:9], *(["y"] * 60), *item[20:]])), ("long", " ".join(["p q"] * 40 + ["alpha beta gamma delta epsilon zeta eta theta"] + ["omega"]))]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    bench = spark.createDataFrame([("s", "One, two three. FOUR"), ("m", " ".join(item)), ("w", "word"), ("l", "alpha beta gamma delta epsilon zeta eta theta"), ("L", "alpha beta gamma delta epsilon zeta eta theta omega " + " ".join(f"o{k}" for k in range(30)))], "item_id string, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, r.coverage) for r in decontaminate.leaks(df, bench).collect())
    assert [g[:4] for g in got] == [("changed", "m", 2, 10), ("changed", "m", 13, 9), ("changed", "m", 23, 9), ("long", "l", 80, 8), ("short", "s", 1, 4)]
    assert {g[4] for g in got if g[0] == "changed"} == {round(28 / 30, 6)}
    assert {r.doc_id: r.text for r in decontaminate.remove_leaks(df, bench).collect()}["changed"] == "a b x10 x20 c"


def test_many_automata_give_the_same_leaks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{BIG}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    cut = sorted((r.doc_id, r.text) for r in decontaminate.remove_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 1500)
    rounds = decontaminate._rounds
    monkeypatch.setattr(decontaminate, "_rounds", lambda b, n: rounds(b, n, 100_000))
    assert len(decontaminate._rounds(bench, 13)) > 1
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == want
    assert sorted((r.doc_id, r.text) for r in decontaminate.remove_leaks(docs, bench).collect()) == cut


def test_leaks_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Intro text. ALPHA, beta gamma; delta epsilon zeta eta theta! Tail."), (2, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_leaks) for r in decontaminate.remove_leaks(docs, bench).collect()}
    assert got == {1: ("Intro text. Tail.", 1), 2: ("clean words only", 0)}


def test_benchmark_items_in_documents_are_found(spark, docs, frame):
    bench = spark.read.parquet(f"{BIG}/benchmark.parquet")
    items = words_of(bench.toPandas().text.tolist())
    holds = {i for i, h in zip(frame.doc_id, words_of(frame.text.tolist()), strict=True) if any(_within(x, h) for x in items)}
    found = {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
    assert holds <= found and holds


def _within(x, h):
    first = x[0]
    return any(h[j] == first and h[j : j + len(x)] == x for j in range(len(h) - len(x) + 1))


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 24, 60_000)
    state, want = line_dedup.OnceTwice(), np.bincount(bits, minlength=1 << 24)
    for part in np.array_split(bits, 7):
        u, n = np.unique(part, return_counts=True)
        state.merge(line_dedup.unpack(line_dedup.pack(u)), line_dedup.unpack(line_dedup.pack(u[n > 1])))
    assert (state.twice == (want > 1)).all()
    keys = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    for bound, least in ((1 << 20, 0.02), (2000, 0.9)):
        rate, probes = line_dedup.rates(6000, bound)
        f = line_dedup.Filter({3: line_dedup.filter_slice(keys[:6000], rate, probes)}, 8, probes)
        at = np.full(9000, 3)
        assert f.has(at, keys)[:6000].all() and f.has(at, keys)[6000:].mean() < least and not f.has(at - 1, keys).any()
        assert f.table.nbytes <= bound + 64


@pytest.mark.parametrize("bound", [1 << 20, 8])
def test_line_dedup_of_awkward_rows_by_sql(spark, bound, monkeypatch):
    """Ids that are missing or repeat, and filters that are full."""
    monkeypatch.setattr(line_dedup, "TASK_LINES", 3)
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, "\n".join(rng.choice(["a", " a", "b\r", "", "c", f"own{k}"]) for _ in range(rng.randint(0, 6)))])) for k in range(120)]
    rows += [rows[0], (None, "only-here"), (None, "only-here-too\nunique"), (5, "m\nshared"), (5, "u0\nunique-line-of-second-row"), (6, "shared")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    con = oracle.duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])}))
    got = line_dedup.dedup_lines(df, bound)
    assert not {c for c in got.columns} - {"doc_id", "text", "n_lines", "n_removed", "n_left"}
    oracle.check(con, got.drop("n_left"), line_dedup.SQL)
    names = df.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert sorted((r.text or "", r.n_removed) for r in line_dedup.dedup_lines(names, bound).collect()) == sorted((r.text or "", r.n_removed) for r in got.collect())
    kept = [x.strip(" \t\r") for r in got.dropDuplicates(["doc_id", "text"]).collect() if r.doc_id is not None and r.text for x in r.text.split("\n") if x.strip(" \t\r")]
    assert {"m", "shared", "unique-line-of-second-row", "u0"} <= set(kept)


def test_language_held_out(spark, docs):
    sample = language.labelled_sample(docs, 64)
    known = {t for t, _ in sample}
    got = language.identify(docs, 64).toPandas()
    rest = got[~got.text.isin(known)]
    assert len(rest) > 500 and (rest.pred_lang == rest.lang).mean() > 0.98 and got.lang_kept.mean() > 0.98


def _spectrum(text):
    import re

    t = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", text.lower())
    return {t[i : i + n] for n in range(1, language.MAX_N + 1) for i in range(len(t) - n + 1)}


def test_grams_are_of_characters():
    texts = ["中文字", "", "a-b", "Ä1ö", None, "  x", "\U0001f600é"]
    d, b = language.grams(pa.array(texts))
    assert np.bincount(d, minlength=7).tolist() == [len(_spectrum(t or "")) for t in texts]


def test_collapsed_scores_are_those_of_the_kernel():
    """Scores against kernel ridge regression on the Nyström features of the kernel, written out."""
    texts = [f"{a} {b}" for a in ("the cät", "der hund", "le chat") for b in ("one two", "eins zwei", "un deux")]
    labels = [x for x in ("en", "de", "fr") for _ in range(3)]
    m = language.fit(texts, labels, 2, 0.1)
    sets = [_spectrum(t) for t in [*texts, "the other cat", "中文"]]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    at = [k for x in m.languages for k in [i for i, y in enumerate(labels) if y == x][:2]]
    k_mm = np.array([[kernel(sets[i], sets[j]) for j in at] for i in at])
    value, vector = np.linalg.eigh(k_mm)
    phi = np.array([[kernel(s, sets[j]) for j in at] for s in sets]) @ vector / np.sqrt(value)
    train, y = np.hstack([phi[:9], np.ones((9, 1))]), np.where(np.array(labels)[:, None] == m.languages, 1.0, -1.0)
    penalty = np.diag([0.1 / 3] * len(at) + [0])
    w = np.linalg.solve(train.T @ train / 9 + penalty, train.T @ y / 9)
    got, count = m.scores(pa.array([*texts, "the other cat", "中文"]))
    want = np.hstack([phi, np.ones((len(sets), 1))]) @ w
    assert np.abs(got - want).max() < 1e-4 and count[-1] == 0
    assert [m.languages[k] for k in got[:9].argmax(1)] == labels


def test_mixture_meets_its_budgets(spark, docs):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    tokens = docs.select("source", F.regexp_count("text", F.lit(r"\S+")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).toPandas().set_index("source").n
    weights = {"src0": 5.0, "src1": 1.0, "src2": 0.01}
    plan = mixture.mixture_plan(docs, labels, weights=weights, budget=100_000, buckets=16).toPandas()
    got = (plan.n_tokens * plan.copies).groupby(plan.source).sum()
    for s, w in weights.items():
        want = int(100_000 * w / sum(weights.values()))
        largest = plan[plan.source == s].n_tokens.max() if s in got else tokens[s]
        assert got.get(s, 0) <= want
        assert plan[plan.source == s].copies.nunique() <= 2
        if want >= tokens[s]:
            assert len(plan[plan.source == s]) and plan[plan.source == s].copies.min() == want // tokens[s]
    same = mixture.mixture_plan(docs, labels, weights=weights, budget=100_000, buckets=4096).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, plan[key].values)) == sorted(map(tuple, same[key].values))


def test_repeated_rows_are_drawn_once(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b", "t"), (2, "d e", "s"), (3, "f", None), (3, "g", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((r.doc_id, r.source, r.copies) for r in mixture.mix_sources(docs, labels, budget=600).collect())
    assert got == sorted((r.doc_id, r.source, r.copies) for r in mixture.mixture_plan(docs, labels, budget=600).collect())
    assert [(i, s) for i, s, _ in got] == [(1, "s"), (2, "s"), (3, "t")]


def test_good_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    drawn = mixture.mixture_plan(docs, labels, budget=2000).toPandas()
    assert len(drawn) == 1000 and (drawn.doc_id % 2).mean() > 0.7


def test_chat_fold_by_hand(spark):
    log = [
        (1, 0, "message", 0, "user", "Hi"),
        (1, 1, "delta", 1, "bot", "Hel"),
        (1, 2, "delta", 1, "bot", "lo"),
        (1, 3, "message", 2, "user", "More"),
        (1, 4, "edit", 0, None, "Hi there"),
        (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", 1, "bot", "Good "),
        (1, 7, "delta", 1, "bot", "day"),
        (1, 8, "message", 2, "user", "Bye"),
        (1, 9, "message", 3, "bot", "gone"),
        (1, 10, "delete", 3, None, None),
    ]
    rows = log[:]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, event string, message long, role string, text string").repartition(3)
    r = chat.format_chats(df, "{role}: {text}", " / ").first()
    assert (r.n_messages, r.chat) == (3, "user: Hi there / bot: Good day / user: Bye")


def test_chat_by_replay(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for c in range(60):
        state = {}
        for s in range(rng.randint(1, 40)):
            event, m, text = rng.choice(["message", "delta", "edit", "regenerate", "delete"]), rng.randrange(4), rng.choice("abc")
            rows.append((c, s, event, m, "r", text))
            if event == "delta":
                state[m] = state.get(m, "") + text
            elif event in ("message", "edit"):
                state[m] = text
            elif event == "delete":
                state.pop(m, None)
            else:
                state = {k: v for k, v in state.items() if k <= m}
                if m in state:
                    state[m] = ""
        if any(state.values()):
            want[c] = "|".join(v for _, v in sorted(state.items()) if v)
    df = spark.createDataFrame(rows, "conv_id long, seq long, event string, message long, role string, text string")
    assert {r.conv_id: r.chat for r in chat.format_chats(df, "{text}", "|").collect()} == want


def test_chat_of_string_ids_ties_and_replays(spark):
    log = [("u-1", 0, "message", 0, "user", "b"), ("u-1", 0, "message", 0, "user", "a"), ("u-1", 1, "delta", 0, "user", "!"), ("u-1", 1, "delta", 0, "user", "!"), ("u-0", 5, "edit", 3, None, "x"), ("", 0, "delta", 0, "", "e")]
    df = spark.createDataFrame(log, "conv_id string, seq int, event string, message int, role string, text string")
    assert sorted((r.conv_id, r.chat) for r in chat.format_chats(df, "{role}:{text}").collect()) == [("", "unknown:e"), ("u-0", "unknown:x"), ("u-1", "user:b!")]


def test_chat_log_of_turns_has_all_events(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    log = chat.events_of_turns(turns)
    assert {r.event for r in log.select("event").distinct().collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    assert log.select("conv_id", "message").distinct().count() > turns.count()
    odd = spark.createDataFrame([("c", 0, None, "x"), ("c", 0, "a", "w"), ("c", 1, "b", None), ("c", 2, "", "yz"), (None, 1, "a", "q"), ("d", None, "a", "q")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.chat) for r in chat.format_chats(chat.events_of_turns(odd), "{role}:{text}", "|").collect()] == [("c", "a:w|unknown:yz")]


@pytest.mark.parametrize("dims, n", [(3, 300), (64, 700), (100, 200)])
def test_topk_by_brute_force(spark, dims, n):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(n, dims)) * np.linspace(3, 0.1, dims)
    x[n // 2] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.id, r.rank): r.neighbour for r in topk.nearest(df.where("vec_id % 3 = 0"), df, 7, sample=40).collect()}
    assert len(got) == 7 * len(range(0, n, 3))
    for i in range(0, n, 3):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[i, r + 1] for r in range(7)] == np.lexsort((np.arange(n), d))[:7].tolist()


def test_topk_of_string_ids_and_foreign_queries(spark):
    base = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0])], "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("z", [0.9, 0.0]), ("a", [0.0, 0.0])], "vec_id string, embedding array<double>")
    got = sorted((r.id, r.rank, r.neighbour) for r in topk.nearest(asked, base, 2).collect())
    assert got == [("a", 1, "b"), ("a", 2, "c"), ("z", 1, "b"), ("z", 2, "c")]


def test_topk_passes_over_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.1 * rng.normal(size=(200, 32)) for c in rng.normal(size=(20, 32))])
    space = topk.Space(32, x[::7], list(range(0, len(x), 7)))
    own = space.cluster(x @ space.axes)
    block = lambda at: topk.Block(x[at], np.ascontiguousarray((x[at] @ space.axes).T.astype(np.float32)), at)
    q = block(np.arange(0, len(x), 50))
    best = topk.Lists(q, space.limits(q.x, q.ids, 5), 5)
    work = sum(topk.search(q, block(np.flatnonzero(own == c)), best) for c in np.unique(own))
    assert work < 0.25 * len(q.ids) * x.size
    for i, ids in zip(q.ids, best.ids, strict=True):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert ids.tolist() == np.argsort(d, kind="stable")[:5].tolist()


def _pieces(text):
    """Tokens and stretches by the description."""
    tokens = text.split()
    hashes = textvec.tokens(pa.array(tokens or [""]))[0].hashes.tolist()
    spans, now = [], []
    for k, h in enumerate(hashes):
        now.append(k)
        if h % lm_score.CUT == 0 or len(now) == lm_score.MOST or k == len(hashes) - 1:
            spans.append(now)
            now = []
    at, places = 0, []
    for t in tokens:
        at = text.index(t, at)
        places.append((at, at + len(t)))
        at += len(t)
    return tokens, [text[places[s[0]][0] : places[s[-1]][1]] for s in spans if len(s) >= lm_score.LEAST]


def _dictionary(texts, capacity):
    single, several = collections.Counter(), collections.Counter()
    for t in texts:
        w, s = _pieces(t)
        single.update(w), several.update(s)
    key = lambda x: textvec.span_hash(textvec.sums(h := textvec.tokens(pa.array([x]))[0].hashes), np.array([0]), np.array([len(h)]))[0] if " " in x else textvec.tokens(pa.array([x]))[0].hashes[0]
    out, left = [], int(capacity * lm_score.STRETCHES)
    for table in (several, single):
        taken, size = [], lambda x: len(x.encode()) + 1
        for x in sorted((x for x, n in table.items() if n > 1), key=lambda x: (-table[x] * (size(x) - lm_score.FREE), int(np.array([key(x)]).view(np.int64)[0]))):
            if size(x) <= left and size(x) > lm_score.FREE:
                taken.append(x)
                left -= size(x)
        left = capacity - sum(size(x) for x in taken)
        out += reversed(taken)
    return "".join(" " + x for x in out).encode()


def test_lm_scores_by_brute_force(spark, docs, frame):
    few = frame[frame.doc_id % 23 == 0]
    inside = {r.doc_id for r in spark.read.parquet(f"{BIG}/labels.parquet").where("quality = 1").collect()}
    some = docs.where("doc_id % 23 = 0").withColumn("doc_id", F.col("doc_id").cast("string"))
    domain = spark.createDataFrame([(str(i),) for i in inside] * 2, "doc_id string")
    got = {r.doc_id: (r.general_bytes, r.domain_bytes) for r in lm_score.lm_scores(some, domain, 6000).collect()}
    sizers = [lm_score.Sizer(_dictionary(x, 6000)) for x in (few.text, few[few.doc_id.isin(inside)].text)]
    assert got == {str(i): tuple(s(t.encode()) for s in sizers) for i, t in zip(few.doc_id, few.text, strict=True)}


def test_pieces_that_do_not_fit_are_passed_over(spark):
    rng = random.Random(9)
    rows = [(k, k, rng.choice([3, 4, 5, 40, 300, 5000]), rng.randint(0, 500)) for k in range(900)]
    gains = spark.createDataFrame(rows, "h long, ref long, size int, gain long")
    for capacity in (3, 50, 700, 5000):
        want, left = [], capacity
        for h, _, size, gain in sorted(rows, key=lambda r: (-r[3], r[0])):
            if gain and size <= left and left > lm_score.FREE:
                want.append(h)
                left -= size
        assert [h for h, _ in lm_score.choose(gains, capacity)] == want


def test_repeated_passages_are_in_the_dictionary(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    rows = [(k, " ".join(word() for _ in range(50)) + (f" {passage} end{k}" if k % 10 == 0 else "")) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.lm_scores(docs, docs.where("doc_id < 0")).toPandas()
    share = (got.general_bytes / got.domain_bytes).groupby(got.doc_id % 10 == 0).mean()
    assert share[True] < 0.75 < 0.95 < share[False]


def test_domain_texts_score_higher(spark):
    rng = random.Random(1)
    vocabulary = [["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(80)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 2]) for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.lm_scores(docs, docs.where("doc_id % 2 = 0")).toPandas()
    by = got.groupby(got.doc_id % 2).lm_score
    assert by.min()[0] > by.max()[1]
    assert (got.general_bytes < got.n_bytes).all()


def test_label_model_recovers_voters():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.15
    accuracy = [0.9, 0.8, 0.85, 0.75]
    v = np.stack([np.where(rng.random(len(y)) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in accuracy] + [np.zeros(len(y))], 1)
    v[:, 4] = v[:, 3]  # a copy of another voter
    u, count = np.unique(v, axis=0, return_counts=True)
    m = toxicity.fit_labels(u.astype(np.int8), count.astype(float))
    assert m.correlation[3, 4] > 0.9 and m.weight[3] < m.weight[0] - 0.05
    assert ((m.posterior(v.astype(np.int8)) > 0.5) == y).mean() > 0.9
    assert (toxicity.decode(toxicity.encode(u.astype(np.int8)), 5) == u).all()


def test_toxicity_against_labels(spark, docs):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    clean, bad = got[got.toxic == 0], got[(got.toxic == 1) & (got.lang == "en")]
    assert clean.is_toxic.mean() < 0.02 and bad.is_toxic.mean() > 0.85


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage against what its operator says of that stage's input."""
    now = docs
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, now, BIG).cache()
        ids, kept = {r.doc_id for r in now.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids
        if name == "language_id":
            assert len(kept) > 0.98 * len(ids)
        if name == "line_dedup":
            lines = collections.Counter(line.strip(" \t\r") for r in out.select("text").collect() for line in r.text.split("\n") if line.strip(" \t\r"))
            assert max(lines.values()) == 1
            gone = [r.text for r in now.where(~F.col("doc_id").isin(*kept)).collect()]
            assert all(line.strip(" \t\r") in lines or not line.strip() for t in gone for line in t.split("\n"))
        if name == "near_dedup":
            assert near_dup.near_groups(out).count() < 0.02 * len(ids)
            groups = near_dup.near_groups(now).toPandas()
            assert set(groups.group_id) <= kept and ids - kept == set(groups[~groups.keep].doc_id)
        if name == "decontaminate":
            assert decontaminate.leaks(out, spark.read.parquet(f"{BIG}/benchmark.parquet")).count() == 0
            assert len(kept) > 0.97 * len(ids)
        if name == "mixture":
            shares = out.select("source", (F.regexp_count("text", F.lit(r"\S+")) * F.col("copies")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).toPandas().n
            assert shares.max() / shares.mean() < 1.05
        now = out
