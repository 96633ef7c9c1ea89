"""Order-dependent folds over the rows of one document, and the operators that need them.

A fold's partitions are sorted, so a task streams over its rows and holds one group at a time; groups are
distributed by their keys in a single shuffle.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.headings import RUNNING
from ..functions.text import BLANKS


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fold: Callable[[list[tuple]], Iterable[tuple]], out: str) -> DataFrame:
    """Apply ``fold`` to the rows (tuples of ``inputs``) of each group in order; ``keys`` and the fields of ``out`` make the result.

    Null keys form groups as other values do; rows of equal order come in the order of ``inputs``. An empty table gives no rows.
    """
    names = list(dict.fromkeys([*keys, *order, *inputs]))
    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(out).fields])
    arrow = to_arrow_schema(schema)
    nk = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, done = None, [], []

        def close() -> None:
            done.extend((*now, *x) for x in fold(rows))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in arrow]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            group = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for key, row in zip(group, zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if key != now:
                    if rows:
                        close()
                    now, rows = key, []
                    if len(done) > 2000:
                        yield flush()
                rows.append(row)
            yield flush()
        if rows:
            close()
            yield flush()

    assert nk
    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order, *[c for c in inputs if c not in order]).mapInArrow(run, schema)


_N = "[一二三四五六七八九十]"
_CHAPTER = re.compile("第[一二三四五六七八九十0-9]+[章节部分]")
_SECOND = re.compile(_N + "+[、.]")
_THIRD = re.compile("[（(]" + _N + "+[)）]")
_FOURTH = re.compile("[0-9]+[、.．]")
_RUNNING = re.compile(RUNNING)
_LIST = re.compile("[(（][0-9]+[)）]|[(（]" + _N + "+[)）]|[0-9]+\\.|[•·▪▫◦‣⁃]")


def breaks_group(text: str) -> bool:
    """A heading of the first or second level opens a new group."""
    bare = text.strip(BLANKS)
    return bool(_CHAPTER.match(bare) or _SECOND.match(bare))


def semantic_groups(elements: DataFrame, parent_size: int = 4000, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(keys, group_no, first_seq, last_seq, n_elements, content)`` of elements ``(keys, seq, page_number, element_type, content)``.

    A group ends before a heading of level 1 or 2, a title, a page more than one away, or an element that would make it larger than
    ``parent_size`` (separators not counted). Null contents are empty.
    """

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        group, size, page, n = [], 0, None, 0
        for seq, at, kind, content in rows:
            text = content or ""
            if group and (breaks_group(text) or kind == "title" or (at is not None and page is not None and abs(at - page) > 1) or size + len(text) > parent_size):
                yield n, group[0][0], group[-1][0], len(group), "\n\n".join(x for _, x in group)
                group, size, n = [], 0, n + 1
            group.append((seq, text))
            size, page = size + len(text), at
        if group:
            yield n, group[0][0], group[-1][0], len(group), "\n\n".join(x for _, x in group)

    return fold_groups(elements, keys, ["seq"], ["seq", "page_number", "element_type", "content"], fold, "group_no int, first_seq int, last_seq int, n_elements int, content string")


def split_large_groups(elements: DataFrame, parent_size: int = 4000, keys: Sequence[str] = ("doc_id", "group_no"), joined: bool = False) -> DataFrame:
    """Parts of groups whose joined text exceeds ``parent_size``; other groups stay one part. Headings and size break, pages do not.

    With ``joined`` the parts carry their content.
    """
    text_of = lambda texts: ("\n\n".join(texts),) if joined else ()

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        texts = [c or "" for _, c in rows]
        if len("\n\n".join(texts)) <= parent_size:
            yield 0, rows[0][0], rows[-1][0], len(rows), *text_of(texts)
            return
        part, size, n = [], 0, 0
        for (seq, _), text in zip(rows, texts, strict=True):
            if part and (breaks_group(text) or size + len(text) > parent_size):
                yield n, part[0][0], part[-1][0], len(part), *text_of([x for _, x in part])
                part, size, n = [], 0, n + 1
            part.append((seq, text))
            size += len(text)
        yield n, part[0][0], part[-1][0], len(part), *text_of([x for _, x in part])

    return fold_groups(elements, keys, ["seq"], ["seq", "content"], fold, "part_no int, first_seq int, last_seq int, n_elements int" + ", content string" * joined)


def _is_cjk(c: str) -> bool:
    return "一" <= c <= "鿿"


def merges(current: str, page: int, text: str, next_page: int) -> bool:
    """Whether a text element continues the paragraph before it."""
    a, b = current.strip(BLANKS), text.strip(BLANKS)
    if not a or not b or next_page > page + 1:
        return False
    bare = _RUNNING.sub("", b)
    if any(p.match(bare) for p in (_CHAPTER, _SECOND, _THIRD, _FOURTH)) or a[-1] in "。！？!?:：;；" or _LIST.match(b):
        return False
    return (_is_cjk(a[-1]) and _is_cjk(b[0])) or ((a[-1].isalnum() or a[-1] == "-") and b[0].isalnum())


def merge_paragraphs(elements: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Elements with paragraphs joined that a page or line end cut: ``(keys, seq, page_number, pages, element_type, content)``.

    A merged element keeps the first one's seq and page and lists all its pages; a hyphen before the cut goes unless it follows Chinese. An element
    without a page number stands on the page of the element before it.
    """

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        now = None
        for seq, page, kind, content in rows:
            content = content or ""
            if now and now[2] == kind == "text" and merges(now[3], now[1] or 0, content, (now[1] or 0) if page is None else page if now[1] is not None else 0):
                a, b = now[3].strip(BLANKS), content.strip(BLANKS)
                if len(a) >= 2 and a[-1] == "-" and not _is_cjk(a[-2]):
                    now[3] = a[:-1] + b
                else:
                    now[3] += ("" if _is_cjk(a[-1]) else " ") + b
                now[4] |= {page} - {None}
                now[1] = page if now[1] is None else now[1]
            else:
                if now:
                    yield now[0], now[1], sorted(now[4]), now[2], now[3]
                now = [seq, page, kind, content, {page} - {None}]
        if now:
            yield now[0], now[1], sorted(now[4]), now[2], now[3]

    return fold_groups(elements, keys, ["seq"], ["seq", "page_number", "element_type", "content"], fold, "seq int, page_number int, pages array<int>, element_type string, content string")


def split_table_by_size(lines: DataFrame, child_size: int = 1200, keys: Sequence[str] = ("table_id",), drop_large: bool = False) -> DataFrame:
    """Parts of tables ``(keys, line_no, line)``: lines are added up to ``child_size``, line ends not counted.

    A line as large as a part is a part of its own; with ``drop_large`` it is dropped where it meets a part begun already, as parity asks for.
    """

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        part, size, n = [], 0, 0
        for _, line in rows:
            line = line or ""
            if part and size + len(line) > child_size:
                yield n, len(part), "\n".join(part)
                n += 1
                part, size = ([line], len(line)) if len(line) < child_size or not drop_large else ([], 0)
            else:
                part.append(line)
                size += len(line)
        if part:
            yield n, len(part), "\n".join(part)

    return fold_groups(lines, keys, ["line_no"], ["line_no", "line"], fold, "part_no int, n_lines int, content string")


_FIGURES = re.compile(r"^[0-9,.\-%\s]+$")
_BULLETS = "-•·└├─"


def row_level_name(cell: str) -> tuple[int, str]:
    bare = cell.lstrip(" \t　")
    indent = (len(cell) - len(bare)) // 2
    level = max(indent, *(k if p.match(bare) else 0 for k, p in ((1, re.compile(_N + "+、")), (2, _THIRD), (3, _FOURTH))))
    if bare[:1] and bare[0] in _BULLETS:
        level, bare = max(level, indent + 1), bare[1:].strip(BLANKS)
    for p in (_N + "+、", "[（(]" + _N + "+[)）]", "[0-9]+[、.．]"):
        bare = re.sub("^" + p, "", bare)
    return level, bare.lstrip(_BULLETS).strip(BLANKS)


def row_paths(rows: DataFrame, depth: int = 4, most: int = 50, keys: Sequence[str] = ("table_id",)) -> DataFrame:
    """``(keys, row_no, path)``: the headings above each row ``(keys, row_no, cell)`` of a table by indent and numbering.

    Rows without a name, or of figures only, repeat the whole path; a named row's path is cut to ``depth`` names and ``most`` characters.
    """

    def fold(given: list[tuple]) -> Iterator[tuple]:
        stack: list[tuple[int, str]] = []
        for no, cell in given:
            cell = (cell or "").rstrip(BLANKS)
            level, name = row_level_name(cell) if cell and not _FIGURES.match(cell) else (0, "")
            if name:
                # levels grow along the stack, so what stays open is what lies above the new row
                stack = [x for x in stack if x[0] < level] + [(level, name)]
                yield no, " / ".join(n for _, n in stack[:depth])[:most]
            else:
                yield no, " / ".join(n for _, n in stack)

    return fold_groups(rows, keys, ["row_no"], ["row_no", "cell"], fold, "row_no int, path string")


#: Near boxes that a page remembers, at four bytes each; beyond them they are looked up again for each row.
_REMEMBERED = 8_000_000


def near_boxes(shapes: np.ndarray, threshold: float) -> Callable[[int], np.ndarray]:
    """A function from the number of a distinct box to those of the boxes that overlap it beyond ``threshold`` (of the union's area).

    Such boxes begin near each other on both axes, by a share of the box's size: rows of boxes by y0, sorted by x0, give the few that are measured.
    """
    x0, y0, x1, y1 = shapes.T
    width, height = x1 - x0, y1 - y0
    area = width * height
    real = np.flatnonzero((width > 0) & (height > 0) & np.isfinite(area))
    if not len(real):
        return lambda k: real
    tall = float(np.median(height[real]))
    row = np.floor(y0 / tall)
    order = real[np.lexsort((x0[real], row[real]))]
    rows, starts = np.unique(row[order], return_index=True)
    ends, along = np.append(starts[1:], len(order)), x0[order]
    far = (1 - threshold) / threshold if threshold else np.inf

    def reach(low: float, size: float) -> tuple[float, float]:
        slack = 1e-9 * (abs(low) + size)
        return low - size * far - slack, low + size * (1 - threshold) + slack

    def near(k: int) -> np.ndarray:
        if not (width[k] > 0 and height[k] > 0):
            return order[:0]
        (left, right), (top, bottom) = reach(x0[k], width[k]), reach(y0[k], height[k])
        found = []
        for i in range(rows.searchsorted(np.floor(top / tall)), rows.searchsorted(np.floor(bottom / tall), "right")):
            at = along[starts[i] : ends[i]]
            found.append(order[starts[i] + at.searchsorted(left) : starts[i] + at.searchsorted(right, "right")])
        c = np.concatenate(found) if found else order[:0]
        w = np.minimum(x1[k], x1[c]) - np.maximum(x0[k], x0[c])
        h = np.minimum(y1[k], y1[c]) - np.maximum(y0[k], y0[c])
        c, w, h = (v[(w > 0) & (h > 0)] for v in (c, w, h))
        both = w * h
        return c[both / (area[c] + area[k] - both) > threshold]

    return near


def merged_rows(fresh: np.ndarray, boxes: np.ndarray, quality: np.ndarray, threshold: float) -> list[int]:
    """Rows of one page, in order, that :func:`merge_boxes` keeps.

    Equal boxes have one number, for which the near ones are found once; of the places that hold a box, the first is at the top of a heap.
    """
    order = np.lexsort(boxes.T)
    new = np.ones(len(boxes), bool)
    new[1:] = (boxes[order][1:] != boxes[order][:-1]).any(axis=1)
    number = np.empty(len(boxes), np.int64)
    number[order] = np.cumsum(new) - 1
    near, known, room = near_boxes(boxes[order][new], threshold), {}, _REMEMBERED
    none = len(boxes)
    first = np.full(int(new.sum()), none)
    places: list[list[int]] = [[] for _ in first]
    of, value = number.tolist(), quality.tolist()
    kept: list[int] = []
    for row, is_fresh in enumerate(fresh.tolist()):
        k, same = of[row], none
        if is_fresh:
            around = known.get(k)
            if around is None:
                around = near(k).astype(np.int32)
                if len(around) <= room:
                    known[k], room = around, room - len(around)
            if len(around):
                same = int(first[around].min())
        if same == none:
            same = len(kept)
            kept.append(row)
        elif value[row] > value[kept[same]]:
            old = of[kept[same]]
            heapq.heappop(places[old])
            first[old] = places[old][0] if places[old] else none
            kept[same] = row
        else:
            continue
        heapq.heappush(places[k], same)
        first[k] = places[k][0]
    return kept


def merge_boxes(boxes: DataFrame, threshold: float = 0.55, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Tables of two detectors on a page merged in order ``ord`` (the first detector's before the second's, ``fresh``).

    A fresh box that overlaps one kept beyond ``threshold`` is the same table and takes its place if its quality is greater; else it is added.
    Of several such kept boxes the first counts. A box without coordinates or extent overlaps none. Returns ``(keys, ord)`` of the boxes that remain.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold is a share of the union, from 0 to less than 1")
    out = T.StructType([*(boxes.schema[k] for k in keys), T.StructField("ord", T.IntegerType())])
    arrow = to_arrow_schema(out)
    names = ("x0", "y0", "x1", "y1", "quality")

    def merge(page: pa.Table) -> pa.Table:
        page = page.sort_by("ord")
        x0, y0, x1, y1, quality = (page.column(c).to_numpy() for c in names)
        fresh = page.column("fresh").fill_null(False).to_numpy()
        return page.select([*keys, "ord"]).take(pa.array(merged_rows(fresh, np.column_stack([x0, y0, x1, y1]), quality, threshold))).cast(arrow)

    rows = boxes.select(*keys, F.col("ord").cast("int").alias("ord"), "fresh", *(F.col(c).cast("double").alias(c) for c in names))
    return rows.groupBy(*keys).applyInArrow(merge, out)


def assign_context(elements: DataFrame, before: int = 10, after: int = 3, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(keys, table_seq, title_seq, note_seq, caption_seq, title_text)``: context of each table, every element serving one table only.

    ``elements`` carry ``(seq, pos, element_type, content, kind, second_kind, numbered_score, is_note, is_caption, page_number)`` where ``pos`` is the
    place in the document; elements that no table looks at may be left out. ``kind`` is the title kind and ``numbered_score`` the title's score before distance and page (see :mod:`.context`). A title must match a pattern and
    score a half; a second title two places away is joined to the earlier of both, for whatever table comes to use it.
    """

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        by_place = {r[9]: r for r in rows}
        texts = {r[9]: r[2] or "" for r in rows}
        used: set[int] = set()
        for row in rows:
            t = row[9]
            if row[1] != "table" or t in used:
                continue
            found = []
            for j in range(max(0, t - before), t):
                r = by_place[j]
                if j in used or r[1] == "table" or not texts[j].strip(BLANKS) or r[3] is None:
                    continue
                base = 0.0
                if len(texts[j].strip(BLANKS)) <= 100:
                    place = 0.1 if r[7] == row[7] else 0.05 if r[7] < row[7] else 0.0
                    base = min(1.0, r[4] * max(0.0, 1 - (t - j - 1) * 0.2) + place)
                if r[3] == "pattern":
                    found.append((j, base, "pattern"))
                if r[8] == "unit":
                    found.append((j, base * 0.8, "unit"))
                elif r[8] == "keyword":
                    found.append((j, base * 0.7, "keyword"))
            found.sort(key=lambda x: -x[1])
            title = note = caption = None
            if found and found[0][2] == "pattern" and found[0][1] >= 0.5:
                title = found[0][0]
                other = next((j for j, _, kind in found[1:] if abs(j - title) <= 2 and kind == "pattern"), None)
                if other is not None:
                    low, high = sorted((title, other))
                    texts[low] = f"{texts[low].strip(BLANKS)}\n{texts[high].strip(BLANKS)}"
                used.add(title)
            for j in range(t + 1, t + after + 1):
                if j in by_place and j not in used and by_place[j][5]:
                    note = j
                    used.add(j)
                    break
            for j in (t - 1, t + 1):
                if j in by_place and j not in used and by_place[j][6]:
                    caption = j
                    used.add(j)
                    break
            used.add(t)
            at = lambda k: None if k is None else by_place[k][0]
            yield row[0], at(title), at(note), at(caption), None if title is None else texts[title]

    return fold_groups(elements, keys, ["seq"], ["seq", "element_type", "content", "kind", "numbered_score", "is_note", "is_caption", "page_number", "second_kind", "pos"], fold, "table_seq int, title_seq int, note_seq int, caption_seq int, title_text string")
