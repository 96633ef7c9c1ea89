"""Language-model scores by compression.

A text's cross-entropy under a corpus is measured by how small zstandard makes it with a dictionary of that corpus. The
score is the difference between the sizes under the general and the in-domain dictionary for each byte of the text: high
where the text looks like the domain.

A dictionary holds single tokens and stretches of several: texts are cut behind tokens that their hashes choose, so a passage that
repeats is cut alike wherever it stands. Tokens and stretches of all documents are counted by their hashes, with a document to find each
in; these counts grow with the corpus. Only what a dictionary of fixed capacity takes is read from its documents and reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_stage, stage
from .line_dedup import FILTER_BYTES, _holds
from .textvec import chunks, span_hash, sums, tokens

#: Capacity of a dictionary in bytes, the share of it for stretches, level of compression, and bytes of a match that cost about as much as they save.
CAPACITY, STRETCHES, LEVEL, FREE = 112_640, 0.5, 3, 2
#: A stretch ends behind a token whose hash is divisible by this, and has so many tokens at least and at most.
CUT, LEAST, MOST = 16, 4, 32


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, long, first byte, behind the last byte) of every token and every stretch (``long``), and the bytes of all texts."""
    w, start, end, raw = tokens(texts)
    n, doc = len(w.hashes), w.doc
    if not n:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none.astype(bool), none, none, raw
    last = (w.hashes % np.uint64(CUT) == 0) | (np.append(doc[1:], -1) != doc)
    # tokens since the cut before; a run longer than MOST is cut at every MOST-th token
    begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    last |= since % MOST == MOST - 1
    b = np.flatnonzero(last)
    a = np.concatenate([[0], b[:-1] + 1])
    ok = b - a + 1 >= LEAST
    a, b = a[ok], b[ok]
    return np.concatenate([doc, doc[a]]), np.concatenate([w.hashes, span_hash(sums(w.hashes), a, b + 1)]), np.repeat([False, True], [n, len(a)]), np.concatenate([start, start[a]]), np.concatenate([end, end[b]]), raw


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            doc, h, long, a, b, _ = pieces(part.column("text"))
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.array((b - a)[at].astype(np.int32)), pa.array(long[at]), part.column("ref").take(pa.array(doc[at]))], ["h", "n", "size", "long", "ref"])


def counts(docs: DataFrame, domain: DataFrame) -> DataFrame:
    """``(h, n, n_domain, size, long, ref)`` of the tokens and stretches of ``docs(doc_id, text)`` that occur more than once.

    ``domain(doc_id)`` names the in-domain documents; ``ref`` is the hash of a document that has the piece. Only texts
    of the domain, as a Bloom filter of its ids lets them through, are shuffled to be joined with the ids.
    """
    inside = domain.where("doc_id is not null").select("doc_id").distinct()
    marked = docs.withColumn("ref", F.xxhash64("doc_id", "text"))
    holds = _holds(inside.select(F.xxhash64("doc_id").alias("h")), FILTER_BYTES)
    own = marked.where("doc_id is not null").where(holds(F.xxhash64("doc_id"))).join(inside.hint("merge"), "doc_id", "left_semi")
    schema = "h long, n long, size int, long boolean, ref long"
    general = marked.select("text", "ref").mapInArrow(_count, schema).withColumn("n_domain", F.lit(0).cast("long"))
    special = own.select("text", "ref").mapInArrow(_count, schema).select("h", F.lit(0).cast("long").alias("n"), "size", "long", "ref", F.col("n").alias("n_domain"))
    summed = general.unionByName(special).groupBy("h").agg(F.sum("n").alias("n"), F.sum("n_domain").alias("n_domain"), F.max("size").alias("size"), F.max("long").alias("long"), F.min("ref").alias("ref"))
    return summed.where("n > 1")


def choose(gains: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """(hash, ref) of the rows of ``gains(h, ref, size, gain)`` that fit, by descending gain, then hash.

    A row that does not fit in what is left is passed over, and those after it are still tried, until none fits.
    """
    out, left = [], capacity
    rest = gains.where("gain > 0").withColumn("step", F.floor(F.log2("gain") * 32))
    while left > FREE:
        rest = rest.where(F.col("size") <= left)
        # rows of twice the capacity, by steps of their gains: no task sends its own best rows to the driver
        least, found = None, 0
        for r in rest.groupBy("step").agg(F.sum("size").alias("bytes")).orderBy(F.desc("step")).collect():
            least, found = r["step"], found + r["bytes"]
            if found >= 2 * capacity:
                break
        if least is None:
            break
        top = rest.where(F.col("step") >= least).orderBy(F.desc("gain"), "h").limit(capacity).collect()
        for r in top:
            if r["size"] <= left:
                out.append((r["h"], r["ref"]))
                left -= r["size"]
        last = top[-1]
        rest = rest.where((F.col("gain") < last["gain"]) | ((F.col("gain") == last["gain"]) & (F.col("h") > last["h"])))
    return out


def dictionary(docs: DataFrame, table: DataFrame, column: str, capacity: int = CAPACITY) -> bytes:
    """Stretches and tokens, each after a space, tokens last and in ascending order of the bytes that they save: a match is cheapest near the end.

    Stretches take ``STRETCHES`` of the capacity at most. What occurs once saves nothing elsewhere and is left out.
    """
    gains = table.where(F.col(column) > 1).select("h", "ref", "long", (F.col("size") + 1).alias("size"), (F.col(column) * (F.col("size") + 1 - FREE)).alias("gain"))
    stretches = choose(gains.where("long"), int(capacity * STRETCHES))
    body = _fetch(docs, stretches)
    words = choose(gains.where("not long"), capacity - sum(len(x) + 1 for x in body))
    return b"".join(b" " + x for x in [*reversed(body), *reversed(_fetch(docs, words))])


def _fetch(docs: DataFrame, chosen: list[tuple[int, int]]) -> list[bytes]:
    """The bytes of the pieces with these hashes, from the documents of these references, of which there are no more than pieces."""
    if not chosen:
        return []
    spark = docs.sparkSession
    refs = F.broadcast(spark.createDataFrame([(r,) for r in {r for _, r in chosen}], "ref long"))
    wanted = spark.sparkContext.broadcast(np.sort(np.array([h for h, _ in chosen], np.int64).view(np.uint64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, h, _, a, b, raw = pieces(part.column("text"))
                at = np.flatnonzero(np.isin(h, wanted.value))
                at = at[np.unique(h[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array([raw[x:y].tobytes() for x, y in zip(a[at], b[at], strict=True)], pa.binary())], ["h", "piece"])

    texts = docs.withColumn("ref", F.xxhash64("doc_id", "text")).join(refs, "ref", "left_semi").select("text")
    found = {r["h"]: bytes(r["piece"]) for r in texts.mapInArrow(read, "h long, piece binary").groupBy("h").agg(F.min("piece").alias("piece")).collect()}
    return [found[h] for h, _ in chosen]


class Sizer:
    """Compressed sizes under one dictionary; an empty one is allowed."""

    def __init__(self, content: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) >= 8:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            options["dict_data"] = d
        self.compressor = zstandard.ZstdCompressor(**options)

    def __call__(self, text: bytes) -> int:
        return len(self.compressor.compress(text))


def score_texts(docs: DataFrame, general: bytes, domain: bytes) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((general, domain))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, d = map(Sizer, shared.value)
        for batch in batches:
            sizes_g, sizes_d, scores, lengths = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                text = text.as_py()
                if text is None:
                    sizes_g.append(None), sizes_d.append(None), scores.append(None), lengths.append(None)
                    continue
                a, b = g(text), d(text)
                sizes_g.append(a), sizes_d.append(b), lengths.append(len(text))
                scores.append(round((a - b) / len(text), 9) if text else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(sizes_g, pa.int64()), pa.array(sizes_d, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_bytes", "general_bytes", "domain_bytes", "lm_score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, general_bytes long, domain_bytes long, lm_score double")


def lm_scores(docs: DataFrame, domain: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, n_bytes, general_bytes, domain_bytes, lm_score)`` for every row of ``docs(doc_id, text)``.

    ``domain(doc_id)`` names the documents of the domain; none at all leaves its dictionary empty. A null text has null
    sizes and score, an empty one the score 0; long texts are compressed whole. Rows that repeat are scored, and counted, each; a null id is
    never in the domain; ids may be of any type. Pieces of equal gain enter a dictionary by their hashes. Extra columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select("doc_id", "text")
    table = stage(counts(docs, domain), "pieces")
    general, inside = dictionary(docs, table, "n", capacity), dictionary(docs, table, "n_domain", capacity)
    drop_stage(table)
    return score_texts(docs, general, inside)
