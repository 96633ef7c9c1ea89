"""Near-duplicate documents by MinHash and an LSH forest.

A text is the set of its runs of ``SHINGLE`` words. Each tree of the forest orders the documents by its own
series of signature values; documents with a long common prefix in such an order are neighbours. A region of a
tree (one prefix of ``LEAST_DEPTH`` values) is compared completely, however large it is, so what is found does not
depend on how many other documents share the prefix: one document against all, which settles a group of copies at
once, and then only those that it left out. A region of n documents that are not similar so takes n * n comparisons.

A region of more than ``HOT`` documents is spread over tasks: each compares its share with the region's first document; those that
it leaves out go, as a query set in blocks, to every share. That finds the same groups, so a Bloom filter may name the hot regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_stage, stage
from .graph import components
from .line_dedup import FILTER_BYTES, _holds
from .textvec import chunks, mix, sums, span_hash, words

SHINGLE, PERMUTATIONS, THRESHOLD = 3, 128, 0.5
TREES, DEPTH, LEAST_DEPTH = 12, 8, 2
#: Documents of a region that are compared with one document at once.
REGION = 2048
#: Documents of a region that one task holds.
HOT = 20_000
_SEEDS = np.random.default_rng(7).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and where each text's begin; a text of fewer words is one shingle, one without words has none."""
    w = words(texts)
    n = np.diff(w.first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    return span_hash(sums(w.hashes), at, np.minimum(at + SHINGLE, np.repeat(w.first[1:], count))), first


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the texts with words, their signatures: PERMUTATIONS minima of 16 bits each)."""
    h, first = shingles(texts)
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((PERMUTATIONS, len(some)), np.uint16)
    if len(some):
        starts = first[:-1][some]
        for j in range(PERMUTATIONS):
            out[j] = mix(np.minimum.reduceat(h * _SEEDS[j], starts)) >> np.uint64(48)
    return some, np.ascontiguousarray(out.T)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            some, sig = signatures(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "sig"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, PERMUTATIONS)
            root, n = np.unique(np.concatenate([_root(sig, t) for t in range(TREES)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(n)], ["root", "n"])


def _root(sig: np.ndarray, tree: int) -> np.ndarray:
    """The region of each document in a tree."""
    return (sig[:, tree * DEPTH].astype(np.int64) << 16 | sig[:, tree * DEPTH + 1]) * TREES + tree


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its label (the series of values that orders it) and the low byte of every value."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            n = part.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(n, PERMUTATIONS)
            low = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
            for t in range(TREES):
                label = sig[:, t * DEPTH : (t + 1) * DEPTH]
                yield pa.RecordBatch.from_arrays([pa.array(_root(sig, t)), pa.array([x.tobytes() for x in label.astype(">u2")], pa.binary()), part.column("doc_id"), low], ["root", "label", "doc_id", "low"])


def _similar(row: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the low bytes, of which unrelated values share one in 256."""
    # eight equal bytes are summed as one word: no byte of it exceeds PERMUTATIONS / 8, nor their sum 255
    words = np.ascontiguousarray(rest == row).view(np.uint64).sum(1, dtype=np.uint64)
    same = (words * np.uint64(0x0101010101010101) >> np.uint64(56)) / rest.shape[1]
    return (same - 1 / 256) / (1 - 1 / 256)


def _alike(low: np.ndarray, row: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows are similar to ``row``, in blocks, so that a large region needs no more memory."""
    return np.concatenate([_similar(row, low[at : at + REGION]) >= threshold for at in range(0, len(low), REGION)])


def link(low: np.ndarray, threshold: float) -> np.ndarray:
    """Component of each row when all pairs of at least ``threshold`` are joined, found without comparing pairs joined already.

    The first row is compared with all; every row outside its component is then compared with all. Each pair of
    two components is so compared, which makes the result that of comparing all pairs.
    """
    comp = np.where(_alike(low, low[0], threshold), 0, np.arange(len(low)))
    comp[0] = 0
    for i in np.flatnonzero(comp):
        for c in np.unique(comp[_alike(low, low[i], threshold)]):
            if c != comp[i]:
                a, b = sorted((int(c), int(comp[i])))
                comp[comp == b] = a
    return comp


def _neighbours(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges from runs of rows with one root; the rows come sorted by root."""

    def edges(root: np.ndarray, ids: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(root)) + 1, [len(root)]])
        u, v = [], []
        for k in np.flatnonzero(np.diff(cuts) > 1):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if b - a == 2:
                if _similar(low[a], low[a + 1 : b])[0] >= threshold:
                    u.append(ids[a : a + 1])
                    v.append(ids[a + 1 : b])
                continue
            comp = link(low[a:b], threshold)
            member = np.flatnonzero(comp != np.arange(b - a))
            u.append(ids[a:b][member])
            v.append(ids[a:b][comp[member]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    kept: list[tuple] = []  # pieces of one region so far
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _arrays(batch)
        if kept and now[0][0] == now[0][-1] == kept[0][0][0]:
            kept.append(now)
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last or kept:
            # the region that the batch ends with may go on; all before is complete
            yield from edges(*(np.concatenate([*(k[j] for k in kept), now[j][:last]]) for j in range(3)))
        kept = [tuple(x[last:].copy() for x in now)]
    if kept:
        yield from edges(*(np.concatenate([k[j] for k in kept]) for j in range(3)))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        batch.column("root").to_numpy(),
        np.array(batch.column("doc_id").to_pylist(), None if pa.types.is_integer(batch.column("doc_id").type) else object),
        np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, PERMUTATIONS),
    )


def _lead(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Whether each document of a hot region is similar to the region's first."""
    for batch in batches:
        if batch.num_rows:
            root, _, low = _arrays(batch)
            first = np.frombuffer(b"".join(batch.column("first_low").to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_similar(first, low) >= threshold)], [*batch.schema.names[:-1], "near"])


def _against(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges of the documents left out (``asks``) to one document of each group of a share that they are similar to; a share's rows come before them."""
    key, first, ids, low, comp, merged = None, None, [], [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, u, v = batch.column("doc_id").type, [], []
        _, doc, rows = _arrays(batch)
        for k, (root, salt, asks, near, leader) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "salt", "asks", "near", "first_id")), strict=True)):
            if (root, salt) != key:
                key, first, ids, low, comp, merged = (root, salt), leader, [], [], [], None
            if not asks:
                ids.append(first if near else doc[k])
                comp.append(0 if near else len(comp) + 1)
                low.append(rows[k])
                continue
            if merged is None:
                merged, low = np.array(comp), np.stack(low) if low else None
            if low is None:
                continue
            hit = np.flatnonzero(_alike(low, rows[k], threshold))
            groups, at = np.unique(merged[hit], return_index=True)
            for g, i in zip(groups, hit[at], strict=True):
                if ids[i] != doc[k]:
                    u.append(doc[k])
                    v.append(ids[i])
                merged[merged == g] = groups[0]
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])


def _hot_edges(planted: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Edges inside regions of any size: of (root, doc_id, low), each region by shares of about HOT documents."""
    rows = stage(planted.select("root", "doc_id", "low"), "hot")
    sizes = rows.groupBy("root").agg(F.ceil(F.count("*") / HOT).cast("int").alias("shares"), F.min(F.struct("doc_id", "low")).alias("first"))
    led = rows.join(sizes, "root").select("root", "shares", "doc_id", "low", F.col("first.doc_id").alias("first_id"), F.col("first.low").alias("first_low"))
    led = stage(led.mapInArrow(lambda it: _lead(it, threshold), f"root long, shares int, doc_id {kind}, low binary, first_id {kind}, near boolean"), "led")
    share = led.select("root", F.pmod(F.xxhash64("doc_id"), "shares").cast("int").alias("salt"), "doc_id", "low", "first_id", "near", F.lit(False).alias("asks"))
    asks = led.where("not near").select("root", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), "doc_id", "low", "first_id", "near", F.lit(True).alias("asks"))
    both = share.union(asks).repartition("root", "salt").sortWithinPartitions("root", "salt", "asks", "doc_id")
    across = both.mapInArrow(lambda it: _against(it, threshold), f"u {kind}, v {kind}")
    return across.union(led.where("near and doc_id <> first_id").select(F.col("doc_id").alias("u"), F.col("first_id").alias("v")))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, group_id, keep)`` for every document that is in a group of two or more.

    Two documents of an estimated Jaccard similarity of at least ``threshold`` belong to one group, and so do
    documents joined by a chain of such pairs; ``group_id`` is the least id, whose document stays (``keep``).
    Texts that differ in case, punctuation or layout alone are equal. Documents with a null id or without words
    (null and empty texts) are in no group. Rows that repeat an id are one document with the words of any of its
    rows. No group at all gives no rows. Long texts count with all their words; ids may be of any type that has an order; extra columns are ignored.

    Pairs meet that share the first two values of one of the 12 orders: of those of similarity 0.5 some 97 %, of 0.7 nearly all, before chains.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    signed = stage(docs.mapInArrow(_sign, f"doc_id {kind}, sig binary"), "signed")
    # equal signatures need no forest: one document of each goes on, the others are joined to it
    exact = stage(signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "distinct")
    copies = signed.join(exact.withColumnRenamed("doc_id", "v"), "sig").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    sizes = exact.mapInArrow(_roots, "root long, n long").groupBy("root").agg(F.sum("n").alias("n"))
    hot = stage(sizes.where(F.col("n") > HOT).select(F.xxhash64("root").alias("h")), "hot_roots")
    holds = _holds(hot, FILTER_BYTES)
    planted = exact.mapInArrow(_plant, f"root long, label binary, doc_id {kind}, low binary").withColumn("hot", holds(F.xxhash64("root")))
    ordered = planted.where("not hot").repartition("root").sortWithinPartitions("root", "label", "doc_id").select("root", "doc_id", "low")
    near = ordered.mapInArrow(lambda it: _neighbours(it, threshold), f"u {kind}, v {kind}")
    found = components(near.union(copies).union(_hot_edges(planted.where("hot"), kind, threshold)))
    for df in (signed, exact, hot):
        drop_stage(df)
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def dedup_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the documents that :func:`near_groups` does not keep; all columns pass through."""
    gone = near_groups(docs, threshold).where("not keep").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
