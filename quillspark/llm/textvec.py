"""Words of an Arrow column of texts as arrays, computed on the bytes of the whole batch at once.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, in lower case; every
other byte separates. Words never span two texts. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is handled alone.
MAX_BYTES = 1 << 21

_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _LETTER[_lo:_hi] = True
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that any bits of them can be compared or ranked."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets (one more than texts), starting at 0."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of at most ``max_bytes`` of text each, one row at least."""
    _, off = byte_view(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _bounds(raw: np.ndarray, off: np.ndarray, letters: np.ndarray = _LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = letters[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    before[cuts] = False
    after[cuts - 1] = False
    return inside, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


@dataclass
class Words:
    """``first[d] .. first[d+1]`` are the words of text d; ``hashes`` has a 64-bit hash of each word."""

    first: np.ndarray
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words that begin at each word, and whether the run stays in its text."""
        return rolling(self.hashes, n), self.room() >= n

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))


def sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` hashes any run of words."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power("base", _BASE, len(hashes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words ``start .. end-1``; equal word sequences have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _power("inverse", _INV, len(prefix))[start] + (end - start).astype(np.uint64))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on (0 where fewer follow)."""
    out = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= n:
        at = np.arange(len(hashes) - n + 1)
        out[: len(at)] = span_hash(sums(hashes), at, at + n)
    return out


def words(texts: pa.Array) -> Words:
    return _words(*byte_view(pc.utf8_lower(texts)), _LETTER)[0]


def _words(raw: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    inside, start, end = _bounds(raw, off, letters)
    first = np.searchsorted(start, off).astype(np.int64)
    if not len(start):
        return Words(first, np.empty(0, np.uint64)), start, end
    coded = _CODES[raw]
    coded[~inside] = 0
    coded *= _power("base", _BASE, len(raw))
    h = np.add.reduceat(coded, start) * _power("inverse", _INV, len(raw))[start]
    return Words(first, mix(h + (end - start).astype(np.uint64))), start, end


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but ASCII blanks as they stand, the places of their first bytes and behind their last, and the bytes."""
    raw, off = byte_view(texts)
    return *_words(raw, off, ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])), raw


def prefixes(texts: pa.Array, sizes: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, (word's index, hash) of the first so many bytes of every word of at least that length.

    The words are those of :func:`words`; a prefix hashes differently from the whole word of the same bytes.
    """
    raw, off = byte_view(pc.utf8_lower(texts))
    inside, start, end = _bounds(raw, off)
    if not len(start):
        return [(np.empty(0, np.int64), np.empty(0, np.uint64)) for _ in sizes]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * _power("base", _BASE, len(raw)), out=total[1:])
    back, length, out = _power("inverse", _INV, len(raw))[start], end - start, []
    for k in sizes:
        at = np.flatnonzero(length >= k)
        out.append((at, mix((total[start[at] + k] - total[start[at]]) * back[at] + np.uint64(1 << 20 | k))))
    return out


def word_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets, within each text as given, of every word's start and end, and the texts' offsets.

    Lower-casing changes no separator, so the words are those of :func:`words`, in the same order.
    """
    raw, off = byte_view(texts)
    _, start, end = _bounds(raw, off)
    return start, end, off


def hash_words(items: list[str]) -> np.ndarray:
    """The hash of each single word given."""
    w = words(pa.array(items, pa.string()))
    if not (np.diff(w.first) == 1).all():
        raise ValueError("each item must be one word")
    return w.hashes


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted ``keys``, or -1."""
    if not len(keys) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)


def hash_cut(wanted: int, total: int) -> int:
    """A bound of 64-bit hashes below which a little more than ``wanted`` of ``total`` rows lie."""
    return max(-(2**63), min(2**63 - 1, int((wanted * 1.05 + 50) / max(total, 1) * 2**64) - 2**63))
