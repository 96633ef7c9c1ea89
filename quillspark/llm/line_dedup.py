"""Corpus-wide line de-duplication with a once-seen and a twice-seen Bloom filter.

1. Every scan task sets one bit for each of its lines in filters of its own: once-seen, and twice-seen where it meets a bit again.
   A single probe among many bits is what compresses best (Mitzenmacher, Compressed Bloom Filters, 2002), so a task's filters
   travel as compressed gaps between bits, a few bits for each line. No line and no hash is shuffled here.
2. Filters are merged piece by piece of the bit space: twice-seen is what any task met twice or two tasks met once.
3. The twice-seen bits become a Bloom filter of a bounded size, which is broadcast. Only lines that it holds are shuffled with their
   text. Grouping by the text itself confirms true repeats and finds the first occurrence.
4. The other occurrences are taken out of their documents. Only documents that lose lines are joined; all others pass by.

The plan is the same at every size. Where repeats are too many for ``FILTER_BYTES`` the filter gets fuller and lets more lines
through to the exact confirmation: with one bit for each repeated line some 60 % of the others. The rows are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_stage, stage
from .textvec import mix

#: Bits of the once-seen filter for each line; log2 of the bits of one piece of it; lines for which a task keeps one pair of filters.
SPACE, PIECE, TASK_LINES = 32, 24, 1 << 20
#: Bound of each filter that is broadcast; bits that it gives each entry below the bound.
FILTER_BYTES, BITS = 64 << 20, 12
_BLANK = b" \t\r"
_KEY = ("doc_id", "part", "copy")


def line_key(line: bytes) -> bytes:
    """What two lines must share to be repeats: the line without outer spaces, tabs and carriage returns."""
    return line.strip(_BLANK)


def pack(bits: np.ndarray) -> bytes:
    """Sorted distinct bit numbers below 2**32 as compressed gaps, byte planes apart."""
    gaps = np.diff(bits.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4")[:, 0], dtype=np.int64)


class OnceTwice:
    """Once-seen and twice-seen bits of one piece, merged from the filters of any number of tasks."""

    def __init__(self, piece: int = PIECE):
        self.once, self.twice = np.zeros(1 << piece, bool), np.zeros(1 << piece, bool)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice[once[self.once[once]]] = True
        self.twice[twice] = True
        self.once[once] = True


class Filter:
    """A Bloom filter in slices, one for each shard of its keys."""

    def __init__(self, slices: dict[int, tuple[int, bytes]], shards: int, probes: int):
        self.bits = np.ones(shards, np.uint64)
        self.bits[list(slices)] = [b for b, _ in slices.values()]
        sizes = np.full(shards, 1, np.int64)  # a shard without slice has one byte without bits
        sizes[list(slices)] = [len(t) for _, t in slices.values()]
        self.base = np.cumsum(sizes) - sizes
        self.table, self.probes = np.zeros(sizes.sum(), np.uint8), probes
        for s, (_, t) in slices.items():
            self.table[self.base[s] : self.base[s] + len(t)] = np.frombuffer(t, np.uint8)

    def has(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        found = np.ones(len(key), bool)
        for byte, bit in _places(key, self.bits[shard], self.probes):
            found &= self.table[self.base[shard] + byte] & bit != 0
        return found


def _places(key: np.ndarray, bits: np.ndarray | np.uint64, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    first = mix(key ^ np.uint64(0x9E3779B97F4A7C15))
    step = mix(first) | np.uint64(1)
    for i in range(probes):
        at = (first + np.uint64(i) * step) % bits
        yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def filter_slice(keys: np.ndarray, rate: float, probes: int) -> tuple[int, bytes]:
    """Bits and table of one shard's slice."""
    bits = max(64, int(len(keys) * rate) + 7 & ~7)
    table = np.zeros(bits // 8, np.uint8)
    for byte, bit in _places(keys, np.uint64(bits), probes):
        np.bitwise_or.at(table, byte, bit)
    return bits, table.tobytes()


def rates(entries: int, bound: int) -> tuple[float, int]:
    """Bits for each entry and probes, so that all slices together stay below ``bound`` bytes."""
    rate = min(float(BITS), bound * 8 / max(entries, 1))
    return rate, int(np.clip(round(rate * 0.69), 1, 4))


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Hash, document index, key and line number of every line that has a key."""
    hashes, docs, keys, numbers = [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for d, text in enumerate(texts):
        if text:
            for n, line in enumerate(text.split(b"\n")):
                if key := line.strip(_BLANK):
                    hashes.append(digest(key))
                    docs.append(d)
                    keys.append(key)
                    numbers.append(n)
    return np.array(hashes, np.uint64), np.array(docs, np.int64), keys, np.array(numbers, np.int32)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def task_filters(batches: Iterator[pa.RecordBatch], log2_bits: int) -> Iterator[pa.RecordBatch]:
    """The filters of a task's lines, a row for each piece that has bits."""

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        bits, count = np.unique(np.concatenate(parts), return_counts=True)
        piece = bits >> np.uint64(PIECE)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(bits)]
        local, again = bits & np.uint64((1 << PIECE) - 1), count > 1
        rows = [(int(piece[a]), pack(local[a:b]), pack(local[a:b][again[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["piece", "once", "twice"])

    parts, size = [], 0
    for batch in batches:
        for part in _small(batch):
            h = _hashes(_texts(part))[0]
            if len(h):
                parts.append(h >> np.uint64(64 - log2_bits))
                size += len(h)
            if size >= TASK_LINES:
                yield emit(parts)
                parts, size = [], 0
    if parts:
        yield emit(parts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twice-seen bits of each piece; the rows come sorted by piece."""

    def emit(piece: int, state: OnceTwice) -> pa.RecordBatch:
        bits = np.flatnonzero(state.twice)
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([len(bits)], pa.int64()), pa.array([pack(bits)], pa.binary())], ["piece", "n", "bits"])

    now, state = None, None
    for batch in batches:
        for piece, once, twice in zip(*(batch.column(c).to_pylist() for c in ("piece", "once", "twice")), strict=True):
            if piece != now:
                if state:
                    yield emit(now, state)
                now, state = piece, OnceTwice()
            state.merge(unpack(once), unpack(twice))
    if state:
        yield emit(now, state)


def suspicion(docs: DataFrame, bound: int = FILTER_BYTES) -> tuple[Filter, int]:
    """The twice-seen filter of all lines of ``docs(text)`` and log2 of the bits of the once-seen filter."""
    total = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    log2_bits = max(PIECE, int(SPACE * max(total, 1) - 1).bit_length())
    pieces = 1 << (log2_bits - PIECE)
    partial = docs.select("text").mapInArrow(lambda it: task_filters(it, log2_bits), "piece int, once binary, twice binary")
    merged = partial.repartition(pieces, "piece").sortWithinPartitions("piece").mapInArrow(_merge, "piece int, n long, bits binary")
    twice = stage(merged, "twice")
    rate, probes = rates(twice.agg(F.sum("n")).first()[0] or 0, bound)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, bits in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                size, table = filter_slice(unpack(bits).astype(np.uint64), rate, probes)
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([size], pa.int64()), pa.array([table], pa.binary())], ["piece", "bits", "slice"])

    found = {r["piece"]: (r["bits"], bytes(r["slice"])) for r in twice.where("n > 0").mapInArrow(slices, "piece int, bits long, slice binary").collect()}
    drop_stage(twice)
    return Filter(found, pieces, probes), log2_bits


def identified(docs: DataFrame, part: str = "part", copy: str = "copy") -> DataFrame:
    """``docs`` with columns that tell apart rows of one ``doc_id``: the text's digest, and a number for rows without id.

    So rows of the same id and text are one document, and each row without id is a document of its own; those rows alone are
    staged, so that their numbers stay the same.
    """
    digest = F.unhex(F.md5("text"))
    named = docs.where("doc_id is not null").withColumns({part: digest, copy: F.lit(0).cast("long")})
    loose = stage(docs.where("doc_id is null").withColumns({part: digest, copy: F.monotonically_increasing_id()}), "loose")
    return named.unionByName(loose)


def repeated_lines(docs: DataFrame, bound: int = FILTER_BYTES) -> DataFrame:
    """``(doc_id, part, copy, line_no)`` of every line of ``docs(doc_id, part, copy, text)`` that is not its first occurrence.

    The first three together name a document, see :func:`identified`. Occurrences are ordered by them, null ids last, then by
    line number from 0. Lines without a key never repeat.
    """
    twice, log2_bits = suspicion(docs, bound)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in _small(batch):
                h, d, keys, numbers = _hashes(_texts(part))
                bits = h >> np.uint64(64 - log2_bits)
                at = np.flatnonzero(known.has((bits >> np.uint64(PIECE)).astype(np.int64), bits & np.uint64((1 << PIECE) - 1)))
                rows = pa.array(d[at])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in _KEY), pa.array(numbers[at]), pa.array([keys[i] for i in at], pa.binary()).cast(pa.string())], [*_KEY, "line_no", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stage(docs.select(*_KEY, "text").mapInArrow(suspects, f"doc_id {kind}, part binary, copy long, line_no int, line string"), "suspects")
    place = F.struct(F.col("doc_id").isNull().alias("last"), *_KEY, "line_no")
    first = found.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("most")).where("first <> most").select("line", "first")
    return found.join(first, "line").where(place != F.col("first")).select(*_KEY, "line_no")


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _holds(keys: DataFrame, bound: int):
    """A column function that says of 64-bit hashes whether ``keys(h)`` may hold them, by a Bloom filter of a bounded size."""
    shards = 256
    rate, probes = rates(keys.count(), bound)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            s, h = batch.column("shard").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if now is not None and s[a] != now:
                        yield emit(now, parts)
                        parts = []
                    now = int(s[a])
                    parts.append(h[a:b].copy())
        if parts:
            yield emit(now, parts)

    def emit(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        bits, table = filter_slice(np.concatenate(parts), rate, probes)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bits], pa.int64()), pa.array([table], pa.binary())], ["shard", "bits", "slice"])

    dealt = keys.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h").repartition("shard").sortWithinPartitions("shard")
    rows = dealt.mapInArrow(slices, "shard int, bits long, slice binary").collect()
    shared = keys.sparkSession.sparkContext.broadcast(Filter({r["shard"]: (r["bits"], bytes(r["slice"])) for r in rows}, shards, probes))

    @F.pandas_udf("boolean")
    def holds(h):
        h = h.to_numpy(np.int64).view(np.uint64)
        return pd.Series(shared.value.has((h % np.uint64(shards)).astype(np.int64), h))

    return holds


def _cut(batches: Iterator[pa.RecordBatch], gone: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _small(batch):
            texts, drops = part.column("text").to_pylist(), part.column(gone).to_pylist()
            out, total, removed, left = [], [], [], []
            for text, drop in zip(texts, drops, strict=True):
                lines, drop = text.split("\n"), set(drop)
                keep = [x for n, x in enumerate(lines) if n not in drop]
                out.append("\n".join(keep))
                total.append(len(lines)), removed.append(len(lines) - len(keep)), left.append(sum(1 for x in keep if x.strip(" \t\r")))
            names = [c for c in part.schema.names if c not in ("text", gone)]
            rest = [part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(total, pa.int32()), pa.array(removed, pa.int32()), pa.array(left, pa.int32())], [*names, "text", "n_lines", "n_removed", "n_left"])


def dedup_lines(docs: DataFrame, bound: int = FILTER_BYTES) -> DataFrame:
    """All rows of ``docs`` with each line's later occurrences in the corpus taken out of ``text``.

    Adds ``n_lines``, ``n_removed`` and ``n_left`` (lines with a key that stay), replacing columns of these
    names; other columns pass through, ``doc_id`` may be of any type that has an order. Null texts stay null with zero counts, empty
    texts stay as they are, blank lines are never removed; long texts are handled line by line like others. Rows that repeat a document id and
    its text are cut alike, as they are one document; rows of one id and other texts, and all rows without id, are documents of their own, those
    without id coming last. Of a line's occurrences that of the least (doc_id, digest of the text, line number) stays. An empty table gives an empty table.
    ``bound`` is the size in bytes of each of the two filters that are broadcast; it does not change the rows.
    """
    docs = docs.drop("n_lines", "n_removed", "n_left")
    part, copy, gone, h = _fresh(docs, "part", "copy", "gone", "h")
    named = identified(docs, part, copy)
    drops = repeated_lines(named.select("doc_id", F.col(part).alias("part"), F.col(copy).alias("copy"), "text"), bound)
    drops = stage(drops.groupBy(*_KEY).agg(F.collect_set("line_no").alias("gone")), "drops")
    holds = _holds(drops.select(F.xxhash64(*_KEY).alias("h")), bound)
    marked = named.withColumn(h, holds(F.xxhash64("doc_id", part, copy)))
    counts = {"n_lines": F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, "n_removed": F.lit(0), "n_left": F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != ""))}
    plain = lambda df: df.select(*docs.columns, *(F.when(F.col("text").isNotNull(), x).otherwise(0).cast("int").alias(c) for c, x in counts.items()))
    few = drops.select(F.col("doc_id").alias("doc_id__"), F.col("part").alias("part__"), F.col("copy").alias("copy__"), F.col("gone").alias(gone))
    joined = marked.where(h).join(few, F.col("doc_id").eqNullSafe(F.col("doc_id__")) & (F.col(part) == F.col("part__")) & (F.col(copy) == F.col("copy__")), "left").drop("doc_id__", "part__", "copy__")
    joined = joined.select(*docs.columns, gone)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text") + "text string, n_lines int, n_removed int, n_left int"
    cut = joined.where(F.col(gone).isNotNull()).mapInArrow(lambda it: _cut(it, gone), schema).select(*docs.columns, "n_lines", "n_removed", "n_left")
    return plain(marked.where(~F.col(h))).union(plain(joined.where(F.col(gone).isNull()))).union(cut)


#: DuckDB SQL of :func:`dedup_lines` for the columns doc_id, text, n_lines, n_removed.
SQL = r"""
WITH docs AS (
  SELECT DISTINCT doc_id, md5(text) AS part, CASE WHEN doc_id IS NULL THEN row_number() OVER () ELSE 0 END AS copy, text FROM documents
), places AS (
  SELECT doc_id, part, copy, n - 1 AS line_no, trim(parts[n], E' \t\r') AS line
  FROM (SELECT doc_id, part, copy, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM docs)
), marks AS (
  SELECT doc_id, part, copy, line_no, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, part, copy, line_no) AS k FROM places WHERE line <> ''
), drops AS (
  SELECT doc_id, part, copy, list(line_no) AS gone FROM marks WHERE k > 1 GROUP BY ALL
), rows AS (
  SELECT doc_id, md5(text) AS part, CASE WHEN doc_id IS NULL THEN row_number() OVER () ELSE 0 END AS copy, text, string_split(text, chr(10)) AS p FROM documents
)
SELECT d.doc_id,
  CASE WHEN g.gone IS NULL THEN d.text
       ELSE array_to_string([p[n] FOR n IN range(1, len(p) + 1) IF NOT list_contains(g.gone, n - 1)], chr(10)) END AS text,
  CAST(coalesce(len(p), 0) AS INT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS INT) AS n_removed
FROM rows d
LEFT JOIN drops g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.part = g.part AND d.copy = g.copy
"""
