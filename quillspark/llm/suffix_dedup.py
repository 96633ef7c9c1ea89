"""Repeated passages by suffix arrays.

Every run of ``PASSAGE`` words that stands more than once in the corpus is found, whatever surrounds it:

1. The least hash of the runs of ``ANCHOR`` words inside a window of ``PASSAGE`` words is the window's anchor. Windows that
   share an anchor's place are one segment, known by its anchor, its content's hash and its place. Equal windows have equal anchors,
   so no repeat can be missed by looking at one anchor at a time.
2. Anchors that stand once are dropped. Segments of equal content are counted, and one of each is kept.
3. Where an anchor has several different segments, the words of one of each are fetched. A suffix array over all
   segments of a task, built by linear grouping, puts equal windows next to each other. The few anchors with more than ``HOT``
   different segments, such as a phrase of a template, are split further: by their whole windows, which are counted by hash.
4. What is repeated is carried back to every occurrence and merged to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .line_dedup import _fresh, identified
from .textvec import chunks, mix, rolling, span_hash, sums, word_bytes, words

PASSAGE, ANCHOR = 50, 8
#: Symbols for which one suffix array is built at least, unless a task has fewer; an anchor's segments stay together.
BLOCK = 200_000
#: Different segments of one anchor that may go to one suffix array.
HOT = 2000
_PLACE = 28


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a sequence of non-negative integers (a proper prefix sorts before what it begins).

    Linear grouping construction. First, suffixes are put into groups by their Lyndon prefixes: groups are taken in
    descending order; the next smaller suffix to the left of each member is found through pointers set before, and
    these are moved up in their groups by how many members point to them. Second, groups are emitted in ascending order:
    each suffix placed puts into their groups, at the next free place, those suffixes whose Lyndon prefix ends where it begins.
    """
    n = len(text) + 1
    if n == 1:
        return []
    text = [x + 1 for x in text]
    text.append(0)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n
    size = [0] * n
    begin = 0
    for k, s in enumerate(order):
        place[s] = k
        if k and text[s] != text[order[k - 1]]:
            begin = k
        group[s] = begin
        size[begin] += 1
    before = [-1] * n
    count = [0] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            before[s] = p
        if end - g > 1:
            for s in members:
                p = before[s]
                if p >= 0 and group[p] == g:
                    way = [s]
                    while p >= 0 and group[p] == g:
                        way.append(p)
                        p = before[p]
                    for s2 in way:
                        before[s2] = p
        pointed = []
        for s in members:
            p = before[s]
            if p >= 0:
                if not count[p]:
                    pointed.append(p)
                count[p] += 1
        if len(pointed) > 1:
            pointed.sort(key=count.__getitem__, reverse=True)
        a = 0
        while a < len(pointed):
            times = count[pointed[a]]
            b = a
            while b < len(pointed) and count[pointed[b]] == times:
                b += 1
            touched: dict[int, int] = {}
            for p in pointed[a:b]:
                old = group[p]
                last = old + size[old] - 1
                q, at = order[last], place[p]
                order[at], order[last] = q, p
                place[q], place[p] = at, last
                size[old] -= 1
                touched[old] = touched.get(old, 0) + 1
            for p in pointed[a:b]:
                old = group[p]
                group[p] = -1 - (old + size[old])
            for p in pointed[a:b]:
                group[p] = -1 - group[p]
            for old, moved in touched.items():
                size[old + size[old]] = moved
            a = b
        for p in pointed:
            count[p] = 0
        end = g
    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return out[1:]


def segments(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, place, anchor, content) of the segments: consecutive windows with one anchor.

    ``start`` is the first window's first word and ``place`` the anchor's distance from it.
    """
    none = np.empty(0, np.int64)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    starts = np.flatnonzero(room >= PASSAGE)
    if not len(starts):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    g = rolling(hashes, ANCHOR)
    places = np.uint64((1 << _PLACE) - 1)
    low = (g & ~places) | np.arange(len(g), dtype=np.uint64)
    # least of each run of PASSAGE - ANCHOR + 1 values, by doubling
    width, have = PASSAGE - ANCHOR + 1, 1
    while have < width:
        step = min(have, width - have)
        low[:-step] = np.minimum(low[:-step], low[step:])
        have += step
    at = (low[starts] & places).astype(np.int64)
    new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)])
    start = starts[new]
    end = starts[np.concatenate([new[1:], [True]])]
    doc = np.searchsorted(first, start, "right") - 1
    offset = at[new] - start
    content = span_hash(sums(hashes), start, end + PASSAGE) + mix(offset.astype(np.uint64))
    return doc, start - first[doc], end - start + 1, offset, g[at[new]], content


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w = words(part.column("text"))
            d, start, n, place, anchor, content = segments(w.hashes, w.first)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id").take(pa.array(d)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(place.astype(np.int16))], ["anchor", "content", "doc_id", "start", "windows", "place"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w = words(part.column("text"))
            lists = part.column("wanted")
            wanted = lists.flatten()
            doc = np.repeat(np.arange(part.num_rows), np.array(lists.value_lengths()))
            get = lambda c, wanted=wanted: np.array(wanted.field(c))
            a = w.first[doc] + get("start")
            b = a + get("windows") + PASSAGE - 1
            ok = b <= w.first[doc + 1]
            prefix = sums(w.hashes)
            ok[ok] = (span_hash(prefix, a[ok], b[ok]) + mix(get("place")[ok].astype(np.uint64))).view(np.int64) == get("content")[ok]  # else another text has the same id
            at = pa.array(np.flatnonzero(ok))
            body = pa.array([w.hashes[x:y].tobytes() for x, y in zip(a[ok], b[ok], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(wanted.field(c).take(at) for c in ("anchor", "content")), part.column("doc_id").take(pa.array(doc[ok])), *(wanted.field(c).take(at) for c in ("start", "place", "seen", "last", "kinds")), body], ["anchor", "content", "doc_id", "start", "place", "seen", "last", "kinds", "body"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a segment by its hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            bodies = [np.frombuffer(b, np.uint64) for b in part.column("body").to_pylist()]
            n = np.array([max(0, len(b) - PASSAGE + 1) for b in bodies])
            if not n.sum():
                continue
            row = np.repeat(np.arange(len(bodies)), n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = np.concatenate([rolling(b, PASSAGE)[:k] for b, k in zip(bodies, n, strict=True)])
            take = lambda c, row=row, part=part: part.column(c).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), take("anchor"), take("content"), pa.array(off.astype(np.int32)), take("doc_id"), pa.array(np.asarray(take("start")) + off.astype(np.int32)), take("seen"), take("last")], ["h", "anchor", "content", "lo", "doc_id", "start", "seen", "last"])


def equal_windows(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, class) of every run of ``PASSAGE`` words in the sequences; equal runs have equal classes."""
    lengths = np.array([len(b) for b in bodies])
    none = np.empty(0, np.int64)
    if not len(bodies) or lengths.max() < PASSAGE:
        return none, none, none
    flat = np.concatenate(bodies)
    _, code = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.empty(first[-1], np.int64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    text[inside] = code + len(bodies)
    text[~inside] = np.arange(len(bodies))  # an own end for each sequence
    order = np.array(suffix_array(text.tolist()), np.int64)
    seq = np.repeat(np.arange(len(bodies)), lengths + 1)
    room = np.repeat(first[1:] - 1, lengths + 1) - np.arange(first[-1])
    order = order[room[order] >= PASSAGE]
    h = rolling(text.astype(np.uint64) + np.uint64(1), PASSAGE)[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    span = np.arange(PASSAGE)
    for some in np.array_split(np.flatnonzero(same), 1 + same.sum() // 20_000):
        same[some] = (text[order[some][:, None] + span] == text[order[some - 1][:, None] + span]).all(1)
    return seq[order], order - first[seq[order]], np.cumsum(~same) - 1


def trim(anchors: np.ndarray, bodies: list[np.ndarray], offsets: np.ndarray) -> list[tuple[int, int]]:
    """The part of each segment that can hold a window that another segment of its anchor has too.

    Equal windows have their anchor at equal places, so going outward from the anchor, a word that no other segment
    of the anchor has at that distance ends what can be repeated.
    """
    lengths = np.array([len(b) for b in bodies])
    seg = np.repeat(np.arange(len(bodies)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    rel = np.arange(first[-1]) - first[seg] - offsets[seg]
    key = mix(np.concatenate(bodies) ^ mix(anchors[seg] + rel.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    alone = count[back] < 2
    lo = np.where(alone & (rel < 0), rel + 1, -(1 << 30))
    hi = np.where(alone & (rel >= 0), rel, 1 << 30)
    low = np.maximum(np.maximum.reduceat(lo, first[:-1]), -offsets)
    high = np.minimum(np.minimum.reduceat(hi, first[:-1]), lengths - offsets)
    return list(zip((low + offsets).tolist(), (high + offsets).tolist(), strict=True))


def _runs(seg: np.ndarray, off: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seg, from, to, own) of consecutive offsets of equal ownership; the input is sorted by seg and offset."""
    new = np.concatenate([[True], (np.diff(seg) != 0) | (np.diff(off) != 1) | (own[1:] != own[:-1])])
    return seg[new], off[new], off[np.concatenate([new[1:], [True]])] + 1, own[new]


def resolve(rows: list[tuple], inside: bool = True) -> tuple[np.ndarray, ...]:
    """Repeated window ranges of ``(anchor, content, doc_id, start, place, seen, last, words)`` rows: (row, from, to, own).

    ``seen`` occurrences of a row's segment stand in documents from ``doc_id`` to ``last``. ``own``: the range's first occurrence in the
    corpus is that of this row. Without ``inside``, what repeats in a single document does not count.
    """
    anchors = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    bodies = [r[7] for r in rows]
    offsets = np.array([r[4] for r in rows], np.int64)
    cut = trim(anchors, bodies, offsets)
    live = [i for i, (a, b) in enumerate(cut) if b - a >= PASSAGE]
    seg, off, cls = equal_windows([bodies[i][cut[i][0] : cut[i][1]] for i in live])
    pick = np.array(live, np.int64)
    seg = pick[seg] if len(seg) else seg
    off = off + np.array([c[0] for c in cut], np.int64)[seg] if len(seg) else off
    seen = np.array([r[5] for r in rows], np.int64)
    names = sorted({x for r in rows for x in (r[2], r[6])})
    rank = {x: k for k, x in enumerate(names)}
    doc, last = (np.array([rank[r[k]] for r in rows], np.int64) for k in (2, 6))
    # segments seen more than once repeat as a whole, also where no other segment has a part of them
    several = seen > 1 if inside else last > doc
    often = np.flatnonzero(several)
    width = np.array([len(b) - PASSAGE + 1 for b in bodies], np.int64)
    if len(often):
        extra_seg = np.repeat(often, width[often])
        extra_off = np.concatenate([np.arange(w) for w in width[often]])
        known = np.isin(extra_seg << 20 | extra_off, seg << 20 | off)
        extra_seg, extra_off = extra_seg[~known], extra_off[~known]
        seg, off = np.concatenate([seg, extra_seg]), np.concatenate([off, extra_off])
        cls = np.concatenate([cls, (cls.max() + 1 if len(cls) else 0) + np.arange(len(extra_seg))])
    if not len(seg):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    if inside:
        keep = (np.bincount(cls, minlength=cls.max() + 1)[cls] > 1) | several[seg]
    else:
        least, most = np.full(cls.max() + 1, len(names)), np.full(cls.max() + 1, -1)
        np.minimum.at(least, cls, doc[seg])
        np.maximum.at(most, cls, last[seg])
        keep = least[cls] < most[cls]
    seg, off, cls = seg[keep], off[keep], cls[keep]
    if not len(seg):
        return seg, seg, seg, seg.astype(bool)
    start = np.array([r[3] for r in rows], np.int64)[seg] + off
    by = np.lexsort((start, doc[seg], cls))
    own = np.zeros(len(seg), bool)
    own[by[np.concatenate([[True], np.diff(cls[by]) != 0])]] = True
    by = np.lexsort((off, seg))
    return _runs(seg[by], off[by], own[by])


def _resolve(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
    def emit(rows: list) -> pa.RecordBatch:
        seg, lo, hi, own = resolve(rows, inside)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in seg], pa.int64()), pa.array([rows[i][1] for i in seg], pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(own)], ["anchor", "content", "lo", "hi", "own"])

    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for *x, body in zip(*(part.column(c).to_pylist() for c in ("anchor", "content", "doc_id", "start", "place", "seen", "last", "body")), strict=True):
                if rows and x[:4] == list(rows[-1][:4]):
                    continue  # a row given twice
                if size >= BLOCK and x[0] != rows[-1][0]:
                    yield emit(rows)
                    rows, size = [], 0
                body = np.frombuffer(body, np.uint64)
                rows.append((*x, body))
                size += len(body) // 2
    if rows:
        yield emit(rows)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge sorted ranges (doc_id, keep, a, b) of words to maximal spans."""
    now: tuple | None = None
    for batch in batches:
        kind, out = batch.column("doc_id").type, []
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "keep", "a", "b")), strict=True):
            if now and row[:2] == now[:2] and row[2] <= now[3]:
                now = (*now[:3], max(now[3], row[3]))
            else:
                if now:
                    out.append(now)
                now = row
        yield _span_batch(out, kind)
    if now:
        yield _span_batch([now], kind)


def _span_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] - r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_())], ["doc_id", "start_word", "n_words", "keep"])


def repeated_spans(docs: DataFrame, inside: bool = False) -> DataFrame:
    """``(doc_id, start_word, n_words, keep)``: the maximal spans of words that runs of ``PASSAGE`` repeated words cover.

    Words compare without case and punctuation. A run counts that stands in two documents; with ``inside`` also one that repeats within one document
    only. For each repeated run, the occurrence of least doc_id, then least place, is the one to keep; the spans of kept and of other occurrences
    are merged apart, so they may overlap at their ends. Extra columns are ignored, ids may be of any type that has an order. Null ids, null texts
    and texts of fewer words give nothing; long texts are searched whole. Rows that repeat an id and its text repeat each other (which ``inside``
    tells), but as one document keep all they have first. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = stage(docs.mapInArrow(_scan, f"anchor long, content long, doc_id {kind}, start int, windows short, place short"), "segments")
    each = found.groupBy("anchor", "content").agg(F.count("*").alias("seen"), F.min(F.struct("doc_id", "start", "windows", "place")).alias("rep"), F.max("doc_id").alias("last"))
    often = each.groupBy("anchor").agg(F.sum("seen").alias("times"), F.count("*").alias("kinds"), F.min("rep.doc_id").alias("least"), F.max("last").alias("most"))
    often = often.where("times > 1" if inside else "least <> most").select("anchor", "kinds")
    groups = stage(each.join(often, "anchor").select("anchor", "content", "seen", "last", "kinds", "rep.*"), "groups")
    wanted = groups.where("kinds > 1").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "content", "start", "windows", "place", "seen", "last", "kinds")).alias("wanted"))
    bodies = stage(docs.join(wanted, "doc_id").mapInArrow(_fetch, f"anchor long, content long, doc_id {kind}, start int, place short, seen long, last {kind}, kinds long, body binary"), "bodies")
    few = bodies.where(F.col("kinds") <= HOT).repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "start")
    mixed = few.mapInArrow(lambda it: _resolve(it, inside), "anchor long, content long, lo int, hi int, own boolean")
    windows = bodies.where(F.col("kinds") > HOT).mapInArrow(_windows, f"h long, anchor long, content long, lo int, doc_id {kind}, start int, seen long, last {kind}").distinct()
    same = windows.groupBy("h").agg(F.sum("seen").alias("times"), F.min(F.struct("doc_id", "start")).alias("first"), F.max("last").alias("most")).where("times > 1" if inside else "first.doc_id <> most")
    hot = windows.join(same, "h").select("anchor", "content", "lo", F.expr("lo + 1").alias("hi"), F.expr("struct(doc_id, start) = first").alias("own"))
    whole = groups.where("kinds = 1").select("anchor", "content", F.lit(0).alias("lo"), F.col("windows").cast("int").alias("hi"), F.lit(True).alias("own"))
    repeated = mixed.union(hot).union(whole).join(groups.select("anchor", "content", F.col("doc_id").alias("rep_doc"), F.col("start").alias("rep_start")), ["anchor", "content"])
    placed = found.select("anchor", "content", "doc_id", "start").join(repeated, ["anchor", "content"])
    ranges = placed.select("doc_id", F.expr("own and doc_id = rep_doc and start = rep_start").alias("keep"), F.expr("start + lo").alias("a"), F.expr(f"start + hi + {PASSAGE - 1}").alias("b"))
    return ranges.repartition("doc_id").sortWithinPartitions("doc_id", "keep", "a", "b").mapInArrow(_spans, f"doc_id {kind}, start_word int, n_words int, keep boolean")


def remove_repeats(docs: DataFrame, inside: bool = False) -> DataFrame:
    """All rows of ``docs`` without the spans of :func:`repeated_spans` that are not to keep, and their number in ``n_spans``.

    The bytes from a span's first word to the next word after it go; what a kept span covers stays. Rows that repeat an id and its text are one
    document and cut alike; rows of one id and other texts, and rows without id, are documents of their own. Texts without such a span, null texts among
    them, stay as they are; all other columns pass through, one named ``n_spans`` is replaced; an empty table gives an empty table.
    """
    docs = docs.drop("n_spans")
    names = docs.columns
    part, copy, key, gone = _fresh(docs, "part", "copy", "key", "gone")
    named = identified(docs, part, copy).withColumn(key, F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(part), copy))
    spans = repeated_spans(named.select(F.col(key).alias("doc_id"), "text"), inside)
    gone_of = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "n_words", "keep")).alias(gone)).where(F.exists(gone, lambda x: ~x["keep"]))
    joined = named.join(gone_of, key, "left").select(*docs.columns, gone)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                col = part.schema.get_field_index("text")
                texts, lists = part.column(col), part.column(part.schema.get_field_index(gone)).to_pylist()
                count = [0] * len(lists)
                if any(lists):
                    begin, _, off = word_bytes(texts)
                    first = np.searchsorted(begin, off)
                    new = texts.cast(pa.binary()).to_pylist()
                    for d, some in enumerate(lists):
                        if some:
                            n = first[d + 1] - first[d]
                            drop = np.zeros(n + 1, bool)
                            for keep in (False, True):
                                for x in some:
                                    if x["keep"] == keep:
                                        drop[x["start_word"] : x["start_word"] + x["n_words"]] = not keep
                            at = np.append(begin[first[d] : first[d + 1]] - off[d], len(new[d]))
                            edge = np.flatnonzero(np.diff(drop, prepend=False))
                            body, text, here = [], new[d], 0
                            for a, b in zip(edge[::2], edge[1::2], strict=True):
                                body.append(text[here : at[a]])
                                here = at[b]
                            new[d] = b"".join([*body, text[here:]])
                            count[d] = len(edge) // 2
                    texts = pa.array(new, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == "text" else part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(count, pa.int32())], [*names, "n_spans"])

    return joined.mapInArrow(cut, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + "n_spans int")
