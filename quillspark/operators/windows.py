"""Sliding windows over long texts, cut at the ends of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.text import BLANKS

#: Sentence ends in the order in which they are tried: the first kind that occurs decides, wherever others stand.
STOPS = "。！？.!?"


def child_spans(text: str, size: int = 1200, overlap: int = 200, least: int = 50) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows of a text; windows of fewer stripped characters than ``least`` are left out."""
    n, start = len(text), 0
    while start < n:
        if start:
            limit = min(start + overlap, n)
            for stop in STOPS:
                k = text.find(stop, start, limit)
                if k >= 0 and k + 1 < n:
                    start = k + 1
                    while start < n and text[start] in " \n\t":
                        start += 1
                    break
        end = min(start + size, n)
        if end < n:
            for stop in STOPS:
                k = text.rfind(stop, start, end)
                if k > start + size // 2:
                    end = k + 1
                    break
        if len(text[start:end].strip(BLANKS)) >= least:
            yield start, end
        if end >= n:
            return
        start = end - overlap


def parent_spans(text: str, size: int = 4000, overlap: int = 200) -> Iterator[tuple[int, int]]:
    """Windows of the sliding strategy: each ends at the last ``。`` beyond its half, if there is one."""
    n, start = len(text), 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            k = text.rfind("。", start, end)
            if k > start + size // 2:
                end = k + 1
        yield start, end
        if end >= n:
            return
        start = end - overlap


def _windows(df: DataFrame, text: str, spans) -> DataFrame:
    keys = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in keys]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, position, start, end, content = [], [], [], [], []
                for i, value in enumerate(part.column(text).to_pylist()):
                    for k, (a, b) in enumerate(spans(value or "")):
                        rows.append(i), position.append(k), start.append(a), end.append(b), content.append(value[a:b])
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in names] + [pa.array(position, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(content, pa.string())], [*names, "position", "start_char", "end_char", "content"])

    out = T.StructType([*keys, *(T.StructField(n, T.IntegerType()) for n in ("position", "start_char", "end_char")), T.StructField("content", T.StringType())])
    return df.mapInArrow(cut, out)


def child_windows(df: DataFrame, text: str = "text", size: int = 1200, overlap: int = 200, least: int = 50) -> DataFrame:
    """One row for each window: the other columns of ``df``, then position, start_char, end_char and content.

    A window's place depends on where the one before it ended, so texts are cut in Arrow batches; everything after is native.
    """
    if not 0 <= overlap < size / 2:
        raise ValueError("the overlap must be less than half of the window, or windows would not advance")
    return _windows(df, text, lambda s: child_spans(s, size, overlap, least))


def parent_windows(df: DataFrame, text: str = "text", size: int = 4000, overlap: int = 200) -> DataFrame:
    if not 0 <= overlap < size / 2:
        raise ValueError("the overlap must be less than half of the window, or windows would not advance")
    return _windows(df, text, lambda s: parent_spans(s, size, overlap))
