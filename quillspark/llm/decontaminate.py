"""Benchmark decontamination with generalised suffix automata.

An automaton accepts every run of words of the normalised test items. Training text is streamed through it,
which gives the longest run of words ending at each place that occurs in some item. Runs that are long enough,
or that cover enough of an item alone or together with others near by, are removed, and so are short items that stand whole.

Items are dealt to automata of a bounded number of words, which are built in tasks of their own and kept as flat arrays.
Automata are broadcast in rounds of a bounded size; nearly always there is one round.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import chunks, member, rolling, span_hash, sums, word_bytes, words

#: A run is removed when it has so many words, or covers this share of some item's words.
LENGTH_LIMIT, COVERAGE_LIMIT = 13, 0.5
#: Words of the least run that is looked at, except for items that stand whole; items of fewer than LEAST_ITEM words are no passages.
SHORTEST, LEAST_ITEM = 6, 2
#: Words of items in one automaton, and bytes of the automata that are broadcast at once.
AUTOMATON_WORDS, ROUND_BYTES = 200_000, 128 << 20
_NONE = (1 << 60, -1, 0)


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, kept as one array per field; state 0 is the start."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: The item of least length (then least id) that contains the state's runs: its length, number, and where in it they end.
    item: list[tuple[int, int, int]] = field(default_factory=lambda: [_NONE])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.item.append(_NONE)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the runs of q that are one longer than p's: q itself or a copy of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self.extend(last, c)

    def name(self, sequence: list[int], item: int) -> None:
        """Mark every state on the sequence's way; the marks climb the links in :meth:`settle`."""
        at = 0
        for end, c in enumerate(sequence, 1):
            at = self.next[at][c]
            self.item[at] = min(self.item[at], (len(sequence), item, end))

    def settle(self) -> None:
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.item[up] = min(self.item[up], self.item[s])



class Flat:
    """A finished automaton as arrays: the edges sorted by state and word, the states' links, lengths and items."""

    def __init__(self, auto: Automaton):
        degree = np.array([len(x) for x in auto.next], np.int64)
        state = np.repeat(np.arange(len(degree)), degree)
        word = np.fromiter((c for x in auto.next for c in x), np.int64, degree.sum())
        to = np.fromiter((t for x in auto.next for t in x.values()), np.int32, degree.sum())
        by = np.argsort(state << 32 | word, kind="stable")
        self.edges, self.to = (state << 32 | word)[by], to[by]
        self.link, self.length = np.array(auto.link, np.int32), np.array(auto.length, np.int32)
        self.item = np.array(auto.item, np.int64)

    def longest(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest run that ends at each place and cannot be prolonged to the right."""
        at = have = 0
        edges, to, link, length = memoryview(self.edges), memoryview(self.to), memoryview(self.link), memoryview(self.length)
        last = len(edges)

        def step(state: int, c: int) -> int:
            key = state << 32 | c
            k = bisect_left(edges, key)
            return to[k] if k < last and edges[k] == key else -1

        for i, c in enumerate(sequence):
            new = step(at, c) if c >= 0 else -1
            if new < 0:
                if have:
                    yield i, have, at
                while new < 0 and at:
                    at = link[at]
                    have = length[at]
                    new = step(at, c) if c >= 0 else -1
                if new < 0:
                    at = have = 0
                    continue
            at, have = new, have + 1
        if have:
            yield len(sequence), have, at


@dataclass
class Index:
    automaton: Flat
    #: Ids of the items by number.
    ids: list
    #: Sorted hashes of the items' words, and of their runs of ``SHORTEST`` words.
    vocabulary: np.ndarray
    seeds: np.ndarray
    #: For each number of words below the length limit: sorted hashes of whole items, and their numbers.
    whole: dict[int, tuple[np.ndarray, np.ndarray]]


def build(items: list[tuple], length_limit: int = LENGTH_LIMIT) -> Index:
    """Items without words are left out; items that repeat are named by the least id."""
    items = sorted(items)
    w = words(pa.array([t for _, t in items], pa.string()))
    vocabulary = np.unique(w.hashes)
    code = member(w.hashes, vocabulary)
    h, ok = w.grams(SHORTEST)
    auto = Automaton()
    sequences = [code[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    for s in sequences:
        auto.add(s)
    for i, s in enumerate(sequences):
        auto.name(s, i)
    auto.settle()
    size, whole = np.diff(w.first), {}
    full = span_hash(sums(w.hashes), w.first[:-1], w.first[1:]) if len(w.hashes) else np.zeros(len(size), np.uint64)
    for n in np.unique(size[(size >= LEAST_ITEM) & (size < length_limit)]).tolist():
        at = np.flatnonzero(size == n)
        keys, first = np.unique(full[at], return_index=True)
        whole[n] = keys, at[first]
    return Index(Flat(auto), [i for i, _ in items], vocabulary, np.unique(h[ok]), whole)


def _together(runs: list[tuple], coverage_limit: float) -> list[tuple]:
    """Of runs (start, end, item, size, from, to) of one text and item in order, those that cover enough of it with others near by.

    ``from .. to`` is the run's place in the item. Runs are near while no more words than the item has lie between them.
    """
    out, now = [], []
    for r in [*runs, None]:
        if now and (r is None or r[0] - now[-1][1] > r[3]):
            size, covered, at = now[0][3], 0, 0
            for a, b in sorted((x[4], x[5]) for x in now):
                covered += max(0, b - max(a, at))
                at = max(at, b)
            if covered >= coverage_limit * size:
                out += [(*x[:4], covered) for x in now]
            now = []
        if r:
            now.append(r)
    return out


def matches(index: Index, hashes: np.ndarray, first: np.ndarray, length_limit: int, coverage_limit: float) -> list[tuple[int, int, int, int, int, int]]:
    """(text, start, end, item's number, item's words, words of it that are covered) of all runs beyond a limit.

    Only stretches in which every run of ``SHORTEST`` words occurs in an item are streamed: any longer match lies in one.
    """
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    out: list[tuple] = []
    for n, (keys, numbers) in index.whole.items():
        if len(hashes) >= n:
            k = member(rolling(hashes, n), keys)
            for at in np.flatnonzero((k >= 0) & (room >= n)).tolist():
                d = int(np.searchsorted(first, at, "right")) - 1
                out.append((d, at - int(first[d]), at - int(first[d]) + n, int(numbers[k[at]]), n, n))
    hit = np.zeros(len(hashes), bool)
    if len(index.seeds):
        hit = (member(rolling(hashes, SHORTEST), index.seeds) >= 0) & (room >= SHORTEST)
    at = np.flatnonzero(hit)
    if not len(at):
        return out
    doc = np.searchsorted(first, at, "right") - 1
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)])
    auto, short = index.automaton, {}
    for a, b, d in zip(at[new].tolist(), at[np.concatenate([new[1:], [True]])].tolist(), doc[new].tolist(), strict=True):
        code = member(hashes[a : b + SHORTEST], index.vocabulary).tolist()
        for end, n, state in auto.longest(code):
            size, item, to = auto.item[state].tolist()
            start = a + end - n - int(first[d])
            if n >= length_limit or (n >= SHORTEST and n >= coverage_limit * size):
                out.append((d, start, start + n, item, size, n))
            if n >= SHORTEST and n < length_limit:
                short.setdefault((d, item), []).append((start, start + n, item, size, to - n, to))
    for (d, _), runs in short.items():
        if len(runs) > 1:
            out += [(d, *r) for r in _together(runs, coverage_limit)]
    best: dict[tuple, tuple] = {}
    for m in out:
        if m[:3] not in best or (-m[5], m[4], m[3]) < (-best[m[:3]][5], best[m[:3]][4], best[m[:3]][3]):
            best[m[:3]] = m
    return sorted(best.values())


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rounds(benchmark: DataFrame, length_limit: int, round_bytes: int = ROUND_BYTES) -> list:
    """Broadcast lists of automata, each list of ``round_bytes`` at most (or of one automaton); they are built in tasks."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (4 * AUTOMATON_WORDS)))

    def make(table: pa.Table) -> pa.Table:
        index = build(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), length_limit)
        return pa.table({"index": pa.array([pickle.dumps(index)], pa.binary())})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    out, now, size = [], [], 0
    for r in dealt.groupBy("part").applyInArrow(make, "index binary").toLocalIterator():
        if now and size + len(r["index"]) > round_bytes:
            out.append(spark.sparkContext.broadcast(now))
            now, size = [], 0
        now.append(bytes(r["index"]))
        size += len(r["index"])
    return [*out, spark.sparkContext.broadcast(now)] if now else out


def leaks(docs: DataFrame, benchmark: DataFrame, length_limit: int = LENGTH_LIMIT, coverage_limit: float = COVERAGE_LIMIT) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, coverage)`` of every run of words of ``docs(doc_id, text)`` beyond a limit.

    A run is maximal: it occurs in ``item_id`` (of the items that contain it the shortest, then the least id) and no longer
    run ending there or prolonging it to the right does. It counts with ``length_limit`` words or more; or with ``SHORTEST``
    words, if it covers ``coverage_limit`` of the item, or does so together with other such runs of that item no farther apart than the item is
    long, as in a copy with changed words; ``coverage`` is then that of all together. Items shorter than the limit also count where they stand whole,
    from ``LEAST_ITEM`` words on. Words compare without case and punctuation. Null and empty texts and items give nothing; long texts
    are searched whole; rows that repeat give their runs again; ids may be of any type that has an order; extra columns are ignored; an empty
    benchmark or table gives no rows.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, n_words long, coverage double"

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in shared.value]
            for batch in batches:
                for part in chunks(batch):
                    w = words(part.column("text"))
                    for index in indexes:
                        found = matches(index, w.hashes, w.first, length_limit, coverage_limit)
                        if found:
                            d, start, end, item, size, covered = np.array(found, np.int64).T
                            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array([index.ids[i] for i in item]), pa.array(start), pa.array(end - start), pa.array(np.round(covered / size, 6))], ["doc_id", "item_id", "start_word", "n_words", "coverage"])

        return find

    texts = docs.select("doc_id", "text")
    found = [texts.mapInArrow(finder(b), schema) for b in _rounds(benchmark, length_limit)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, length_limit: int = LENGTH_LIMIT, coverage_limit: float = COVERAGE_LIMIT) -> DataFrame:
    """All rows of ``docs`` with the runs of :func:`leaks` taken out of ``text``, and their count in ``n_leaks``.

    The bytes from the run's first word to the next word after it go; overlapping runs go as one. Texts without such a run,
    null texts among them, stay as they are. All other columns pass through; one named ``n_leaks`` is replaced.
    """
    docs = docs.drop("n_leaks")
    spans = "spans"
    while spans in {c.lower() for c in docs.columns}:
        spans += "_"
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    kind = pa.list_(pa.int64())

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in shared.value]
            for batch in batches:
                for part in chunks(batch):
                    w = words(part.column("text"))
                    rows = part.column(part.schema.get_field_index(spans)).to_pylist()
                    for index in indexes:
                        for d, start, end, *_ in matches(index, w.hashes, w.first, length_limit, coverage_limit):
                            rows[d] = [*(rows[d] or ()), start, end]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, kind)], part.schema.names)

        return find

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                col = part.schema.get_field_index("text")
                texts = part.column(col)
                rows = {d: list(zip(x[::2], x[1::2], strict=True)) for d, x in enumerate(part.columns[-1].to_pylist()) if x}
                count = np.zeros(part.num_rows, np.int32)
                if rows:
                    begin, _, off = word_bytes(texts)
                    first = np.searchsorted(begin, off)
                    new = texts.cast(pa.binary()).to_pylist()
                    for d, runs in rows.items():
                        text, base, lo, hi = new[d], off[d], first[d], first[d + 1]
                        kept, at = [], 0
                        runs = _cover(runs)
                        for a, b in runs:
                            kept.append(text[at : begin[lo + a] - base])
                            at = begin[lo + b] - base if lo + b < hi else len(text)
                        new[d] = b"".join([*kept, text[at:]])
                        count[d] = len(runs)
                    texts = pa.array(new, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == col else c for i, c in enumerate(part.columns[:-1])] + [pa.array(count)], [*part.schema.names[:-1], "n_leaks"])

    marked = docs.withColumn(spans, F.lit(None).cast("array<long>"))
    for b in _rounds(benchmark, length_limit):
        marked = marked.mapInArrow(finder(b), f"{plain}`{spans}` array<long>")
    return marked.mapInArrow(clean, f"{plain}n_leaks int")
