"""From positioned text items to lines and blocks, page by page; OCR paragraphs to blocks.

Clustering items to lines and folding lines to blocks depend on the order of what came before. Rows of a page stand
together, in order, and go through Python in Arrow batches of many pages. Pages whose lines stand apart are clustered
by vector operations, and the others one by one by the same rule; everything around them is built-in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import COUNTED
from ..functions.text import js
from .blocks import CELL, CONTENTS_ENTRY, DECORATIVE, LIST

LINES = "doc_id string, page_number int, line_index int, y double, height double, x double, width double, text string, cells array<string>, n_items int, baseline_spread double, font_spread double, median_font double"
OPERATOR = re.compile(r"[=+\-−*/×÷·⋅±≈<>≤≥→↔∝]")
NO_SPACE_BEFORE = re.compile(r"[),.;:%!?}\]²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]")
NO_SPACE_AFTER = re.compile(r"[(\[{_^]$")


class Line:
    def __init__(self, part):
        self.parts, self.height, self.y = [part], part["font"], part["y"]

    def add(self, part) -> None:
        self.parts.append(part)
        self.height = max(self.height, part["font"])
        self.y = sum(p["y"] for p in self.parts) / len(self.parts)

    def ordered(self) -> list:
        near = max(1.2, self.height * 0.08)
        return [p for p in sorted(self.parts, key=cmp_to_key(lambda a, b: a["x"] - b["x"] if abs(a["x"] - b["x"]) > near else b["y"] - a["y"])) if p["text"]]

    def cells(self) -> list[str]:
        """Text of the line, cut where the gap is that of a column."""
        out, before = [""], None
        for p in self.ordered():
            if before:
                gap, width = p["x"] - before["end"], before["width"] / len(before["text"])
                joint = OPERATOR.fullmatch(before["text"]) or OPERATOR.fullmatch(p["text"])
                tight = NO_SPACE_AFTER.search(before["text"]) or NO_SPACE_BEFORE.match(p["text"])
                if gap >= max(width * 4.8, self.height * 1.35, 18) and not joint and not tight:
                    out.append("")
                elif gap > max(width * 0.65, 3) and (joint or not tight):
                    out[-1] += " "
            out[-1] += p["text"]
            before = p
        return [c for c in (" ".join(x.split()) for x in out) if c]


def page_lines(page: pd.DataFrame) -> list[Line]:
    parts = []
    for r in page.sort_values("item_seq").itertuples():
        text, font = " ".join((r.str or "").split()), abs(r.font_size or 0) or 12
        width = r.width if r.width and r.width == r.width else max(len(text) * font * 0.42, 0)
        parts.append({"text": text, "x": r.x, "y": r.y, "font": font, "width": width, "end": r.x + width})
    median = pd.Series([p["font"] for p in parts]).median() or 12
    near = max(median * 0.45, 2.5)
    lines: list[Line] = []
    for part in sorted(parts, key=cmp_to_key(lambda a, b: b["y"] - a["y"] if abs(a["y"] - b["y"]) > near else a["x"] - b["x"])):
        closest = min((line for line in lines if abs(line.y - part["y"]) <= near), key=lambda line: abs(line.y - part["y"]), default=None)
        if closest:
            closest.add(part)
        else:
            lines.append(Line(part))
    return lines


LINE_COLUMNS = [c.split()[0] for c in LINES.split(", ")]
LINE_TYPES = pa.schema(dict(zip(LINE_COLUMNS, [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.list_(pa.string()), pa.int32(), *[pa.float64()] * 3], strict=True)))
#: Rows that are worked on at a time, or those of one page if it has more.
AT_ONCE = 1 << 16


def in_pages(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a page together, in order."""
    return rows.repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", *order)


def page_starts(rows: pa.Table, rising: list[str]) -> np.ndarray:
    """Whether a page begins at a row: another page than before it, or a place (columns rising, if any) not behind the one before."""
    new, n = np.ones(rows.num_rows, bool), rows.num_rows
    places = [rows[c].fill_null(0).to_numpy() for c in rising]
    later = np.zeros(max(n - 1, 0), bool)
    for place in reversed(places):
        later = (place[1:] > place[:-1]) | ((place[1:] == place[:-1]) & later)
    if n:
        new[1:] = ~later if places else False
        for c in ("doc_id", "page_number"):
            code = rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
    return new


def whole_pages(batches: Iterator[pa.RecordBatch], rising: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pages, with the number of each row's page in the table."""
    held, n, enough = [], 0, AT_ONCE
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        new = page_starts(rows, rising)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield rows.slice(0, last), np.cumsum(new[:last]) - 1
        held, n = rows.slice(last).to_batches(), rows.num_rows - last
        enough = max(AT_ONCE, 2 * n)
    if n:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.cumsum(page_starts(rows, rising)) - 1


def _bands(keys: np.ndarray, page: np.ndarray, near: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of page and key, where bands begin in it, and whether a page's bands (by page) are plain.

    A band ends where the next key is more than near away. It is plain if all its keys are within near of each other: then
    "near each other" is an equivalence, and whatever goes by it is these bands.
    """
    order = np.arange(len(keys))
    if ((page[1:] == page[:-1]) & ~(keys[1:] >= keys[:-1])).any():
        order = np.lexsort((order, keys, page))
    k, g, far = keys[order], page[order], near[order]
    gap = k[1:] - k[:-1]
    other = g[1:] != g[:-1]
    new = np.concatenate([[True], other | (gap > far[1:])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    plain = np.ones(g[-1] + 1, bool)
    plain[g[first[~(k[last] - k[first] <= far[first] * (1 - slack))]]] = False
    plain[g[1:][~other & new[1:] & ~(gap > far[1:] * (1 + slack))]] = False
    return order, new, plain


def _by_place(order: np.ndarray, band: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows in the order of band, then x, then as they came."""
    own = x[order]
    same = band[1:] == band[:-1]
    if (same & ((own[1:] < own[:-1]) | ((own[1:] == own[:-1]) & (order[1:] < order[:-1])))).any():
        return order[np.lexsort((order, own, band))]
    return order


def _medians(values: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The median of each page's values; pages are numbered from 0 and none is without rows."""
    ranked = values[np.lexsort((values, page))]
    n = np.bincount(page)
    start = np.cumsum(n) - n
    return (ranked[start + (n - 1) // 2] + ranked[start + n // 2]) / 2


def _odd_page(page: pd.DataFrame) -> list[tuple]:
    """The lines of one page, whatever its items."""
    median, rows = page["font_size"].abs().replace(0, 12).median() or 12, []
    for i, line in enumerate(page_lines(page)):
        cells, fonts, ys = line.cells(), [p["font"] for p in line.parts], [p["y"] for p in line.parts]
        left = min(p["x"] for p in line.parts)
        rows.append((page["doc_id"].iloc[0], page["page_number"].iloc[0], i, line.y, line.height, left, max(p["end"] for p in line.parts) - left, " ".join(cells), cells, len(line.parts), max(ys) - min(ys), (max(fonts) - min(fonts)) / max(fonts), median))
    return rows


def _joined(elements: pa.Array, starts: np.ndarray) -> pa.Array:
    """Strings, each the elements from one start up to the next or the end; no byte is copied."""
    _, offsets, data = elements.buffers()
    ends = np.frombuffer(offsets, np.int32, len(elements) + 1)
    cut = np.append(ends[starts], ends[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(cut), data)


def _clustered(rows: pa.Table, page: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lines of whole pages of items: what page_lines and Line.cells give for each page."""
    x, y, font, width = (rows[c].to_numpy().astype(np.float64) for c in ("x", "y", "font_size", "width"))
    font = np.abs(font)
    font[font == 0] = 12
    coded = rows["str"].combine_chunks().dictionary_encode("encode")
    texts = [" ".join((t or "").split()) for t in coded.dictionary.to_pylist()]
    code, lengths = coded.indices.to_numpy(), np.array([len(t) for t in texts])
    width = np.where(np.isnan(width) | (width == 0), np.maximum(lengths[code] * font * 0.42, 0), width)
    end = x + width
    # a mean of places can leave their range by rounding: the slack is far above that
    sound = np.isfinite(x) & np.isfinite(font) & np.isfinite(end) & (np.abs(y) < 1e6)
    median = _medians(font, page)
    order, new, plain = _bands(-y, page, np.maximum(median * 0.45, 2.5)[page], 1e-9)
    plain[page[~sound]] = False
    order = _by_place(order, np.cumsum(new), x)
    height = np.maximum.reduceat(font[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    close = ~new[1:] & (x[order][1:] - x[order][:-1] <= np.maximum(1.2, height[1:] * 0.08))
    plain[page[order][1:][close & (y[order][:-1] < y[order][1:])]] = False
    for at in np.flatnonzero(~plain):
        found = _odd_page(rows.filter(pa.array(page == at)).to_pandas())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*found, strict=True)), LINE_TYPES.types, strict=True)], schema=LINE_TYPES)
    good = plain[page[order]]
    order, new, height = order[good], new[good], height[good]
    if not len(order):
        return
    x, y, font, width, end, code, page = (c[order] for c in (x, y, font, width, end, code, page))
    first, line = np.flatnonzero(new), np.cumsum(new) - 1
    n = np.diff(np.append(first, len(order)))
    low, high = np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    mean = low * n / n
    for i in np.flatnonzero((low != high) | (low * 1024 != np.rint(low * 1024))).tolist():
        mean[i] = sum(y[first[i] : first[i] + n[i]].tolist()) / int(n[i]) if n[i] > 1 else low[i]
    # cells: only items with a text, each beside the next of its line
    joint, before, after = (np.array([bool(p(t)) for t in texts]) for p in (OPERATOR.fullmatch, NO_SPACE_BEFORE.match, NO_SPACE_AFTER.search))
    some = np.flatnonzero(lengths[code] > 0)
    here, c = some[:-1], code[some]
    beside = line[some][1:] == line[some][:-1]
    gap, each = x[some][1:] - end[here], width[here] / lengths[c[:-1]]
    both, tight = joint[c[:-1]] | joint[c[1:]], after[c[:-1]] | before[c[1:]]
    apart = beside & (gap >= np.maximum(np.maximum(each * 4.8, height[some][1:] * 1.35), 18)) & ~both & ~tight
    space = beside & ~apart & (gap > np.maximum(each * 0.65, 3)) & (both | ~tight)
    spaced = pa.array([*texts, *(t + " " for t in texts)], pa.string())
    ended = lambda flag: spaced.take(pa.array(c + len(texts) * np.append(flag, False)[: len(c)]))
    starts_cell = np.concatenate([[True], apart | ~beside])[: len(c)]
    cells = _joined(ended(space), np.flatnonzero(starts_cell))
    per_line = np.bincount(line[some][starts_cell], minlength=len(first))
    text = _joined(ended(space | apart), np.searchsorted(line[some], np.arange(len(first))))
    cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_line)), pa.int32()), cells)
    owner = pa.array(order[first])
    number = np.flatnonzero(np.append(True, page[first][1:] != page[first][:-1]))
    index = np.arange(len(first)) - np.repeat(number, np.diff(np.append(number, len(first))))
    left, fonts = np.minimum.reduceat(x, first), np.maximum.reduceat(font, first)
    columns = [rows["doc_id"].take(owner).combine_chunks(), rows["page_number"].take(owner).combine_chunks(), index, mean, fonts, left, np.maximum.reduceat(end, first) - left, text, cells, n, high - low, (fonts - np.minimum.reduceat(font, first)) / fonts, median[page[first]]]
    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, LINE_TYPES.types, strict=True)], schema=LINE_TYPES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of arrays as a row for each of their entries; doc_id and page_number, which come first, are repeated."""
    for batch in batches:
        owner = pc.list_parent_indices(batch.column(2))
        yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in batch.columns[:2]), *(c.flatten() for c in batch.columns[2:])], batch.schema.names)


def lines(items: DataFrame, together: bool = False) -> DataFrame:
    """One row a line: place, cells, metrics; the lines of a page follow each other.

    together: the items of a page already follow each other in a partition with rising item_seq, and nothing is shuffled;
    a repeated or falling item_seq begins another page. A row may then hold many items, in arrays of equal length
    without nulls: Spark's way to Python costs microseconds a row, whatever is in it.
    """
    packed = together and isinstance(items.schema["str"].dataType, T.ArrayType)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, page in whole_pages(_unpacked(batches) if packed else batches, ["item_seq"] if together else []):
            yield from _clustered(rows, page)

    double = "array<double>" if packed else "double"
    own = items.select("doc_id", "page_number", "item_seq", "str", *(F.col(c).cast(double).alias(c) for c in ("x", "y", "font_size", "width")))
    return (own if together else in_pages(own, "item_seq")).mapInArrow(cluster, LINES)


BLOCKS = "doc_id string, page_number int, block_index int, type string, text string, x double, y double, width double, height double, rows array<array<string>>"
ENTRY, DECOR, LISTED = (re.compile(p.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")) for p in (CONTENTS_ENTRY, DECORATIVE, LIST))
ENDS, LOWER = re.compile(r"[:.!?]$"), re.compile("[a-zàâäéèêëîïôöùûüÿœæç]")


BLOCK_COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]
BLOCK_TYPES = pa.schema(dict(zip(BLOCK_COLUMNS, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.list_(pa.list_(pa.string()))], strict=True)))


def _entry(text: str) -> bool:
    return "-" in text and bool(ENTRY.search(text))


class Fold:
    """Blocks of one page, line by line: a line opens a block unless it goes on from the last."""

    def __init__(self):
        self.blocks, self.y, self.height = [], None, 0.0

    def add(self, kind: str, text: str, x: float, y: float, width: float, height: float, cells: list[str] | None) -> None:
        blocks = self.blocks
        gap, tall = (abs(self.y - y), max(self.height, height)) if self.y is not None else (2 * height, height)
        last = blocks[-1] if blocks else None
        opens, wraps = not last or last["type"] != kind or kind == "list", False
        if kind == "heading" and last and last["type"] == "heading":
            decorated = bool(DECOR.search(last["text"]) or DECOR.search(text))
            wraps = not decorated and not ENDS.search(last["text"].strip()) and gap <= 2.2 * tall and bool(LOWER.match(text.strip()))
            opens = opens or not wraps and (gap > 1.32 * tall or bool(ENDS.search(last["text"])) or decorated)
        opens = opens or gap > (2.2 if kind == "formula" else 1.7) * tall or kind == "paragraph" and bool(ENDS.search(last["text"][-2:])) or _entry(text) or _entry(last["text"])
        if opens and not wraps:
            blocks.append({"type": kind, "text": text, "x": x, "y": y, "end": x + width, "height": height, "rows": [cells] if kind == "table" else None})
        else:
            last["text"] += ("\n" if kind == "formula" else " ") + text
            last["x"], last["end"], last["height"] = min(last["x"], x), max(last["end"], x + width), max(last["height"], height)
            if last["rows"] is not None:
                last["rows"].append(cells)
        self.y, self.height = y, height


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, those of a page together from line_index 0 on, to blocks."""
    place, page, out = None, Fold(), []

    def done() -> None:
        out.extend((*place, i, b["type"], b["text"], b["x"], b["y"], b["end"] - b["x"], b["height"], b["rows"]) for i, b in enumerate(page.blocks))

    def put() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), BLOCK_TYPES.types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=BLOCK_TYPES)

    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        cells = named.pop("cells")
        columns = (named[c].to_pylist() for c in ("doc_id", "page_number", "line_index", "type", "text", "x", "y", "width", "height"))
        for i, (doc, number, index, kind, text, x, y, width, height) in enumerate(zip(*columns, strict=True)):
            if index == 0:
                done()
                place, page = (doc, number), Fold()
            if text:
                page.add(kind, text, x, y, width, height, cells[i].as_py() if kind == "table" else None)
        if out:
            yield put()
    if place:
        done()
    if out:
        yield put()


#: Signs, figures and letters of formulas. Of a line without any, spreads alone score too little for a formula.
SIGNS = "[" + "".join(sorted({f"\\x{{{ord(c):X}}}" for c in "".join(COUNTED.values()) + "∆µϵϱϕ²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉·⋅•"})) + "]"


def typed_lines(found: DataFrame) -> DataFrame:
    from ..functions.math import measured, n_units, normalise_notation
    from .blocks import block_type, table_like

    metrics = {"baseline_spread": F.col("baseline_spread"), "line_height": F.col("height"), "font_spread": F.col("font_spread")}
    asked = found.withColumn("asked", F.when(F.col("text").rlike(SIGNS), F.array_join("cells", ". ")).otherwise(""))
    asked = asked.withColumn("units", n_units(normalise_notation(F.col("asked"))))
    out = measured(asked, F.col("asked"), F.col("units"), metrics)
    large = F.col("height") >= F.col("median_font") * 1.2
    is_table = ~F.col("is_formula") & ~(large & (F.length("text") <= 90)) & table_like(F.col("cells"), F.col("n_items"))
    kind = block_type(F.col("text"), F.col("is_formula"), is_table, large)
    text = F.when(is_table, F.array_join("cells", CELL)).when(F.col("is_formula"), F.col("norm")).otherwise(F.col("text"))
    return out.withColumn("type", kind).withColumn("text", text).select(*found.columns, "type")


def blocks(items: DataFrame, together: bool = False) -> DataFrame:
    """Items to typed blocks: cluster, classify in built-in expressions, fold. Lines stay in the order that lines() gives them."""
    return typed_lines(lines(items, together)).select("doc_id", "page_number", "line_index", "type", "text", "x", "y", "width", "height", "cells").mapInArrow(fold, BLOCKS)


def ocr_text(text):
    """NUL and line-end hyphens go, white space is tidied."""
    out = F.replace(F.replace(F.replace(text, F.lit("\u0000"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern, to in ((r"[ \t]+\n", "\n"), (r"(\p{L})-\n(\p{L})", "$1$2"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def ocr_type(text):
    upper = text.rlike(r"^[\p{Lu}0-9\s'’.,:;!?()-]+$") & text.rlike(r"\p{Lu}") & (F.length(text) <= 88)
    simple = text.rlike(r"^[\p{L}0-9\s'’,:()-]+$") & (F.length(text) <= 92) & (F.regexp_count(text, F.lit("[.!?]")) < 2)
    return F.when(text.rlike(js(LIST)), "list").when(upper | simple, "heading").otherwise("paragraph")


OCR = "doc_id string, page_number int, block_index int, type string, text string, x double, y double, width double, height double, confidence double"


def _read(rows: pa.Table, page: np.ndarray, tolerance: float) -> pa.Table:
    """Paragraphs of whole pages in reading order, numbered: from above, and from the left where y is within tolerance."""
    some = pc.not_equal(rows["text"], "").fill_null(False)
    page = np.unique(page[some.to_numpy()], return_inverse=True)[1]
    rows = rows.filter(some)
    if not rows.num_rows:
        return rows.append_column("block_index", pa.array([], pa.int32()))
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    order, new, plain = _bands(y, page, np.full(len(y), tolerance))
    order = _by_place(order, np.cumsum(new), x)
    first = np.searchsorted(page, np.arange(page[-1] + 2))
    for at in np.flatnonzero(~plain).tolist():
        own = slice(first[at], first[at + 1])
        places = list(zip(y[own].tolist(), x[own].tolist(), range(own.start, own.stop), strict=True))
        places.sort(key=cmp_to_key(lambda a, b: a[0] - b[0] if abs(a[0] - b[0]) > tolerance else a[1] - b[1]))
        order[own] = [p[2] for p in places]
    return rows.take(pa.array(order)).append_column("block_index", pa.array(np.arange(len(page)) - first[page], pa.int32()))


def ocr_blocks(paragraphs: DataFrame, tolerance: float = 14.0, together: bool = False) -> DataFrame:
    """OCR paragraphs to blocks in reading order; boxes are rounded, held to the page and 24 units at least.

    together: the paragraphs of a page already follow each other in a partition with rising (block_seq, par_seq), and
    nothing is shuffled; a repeated or falling place begins another page.
    """
    whole = lambda c: F.floor(c + 0.5)
    x = F.greatest(F.lit(0), whole(F.least("x0", "x1")))
    y = F.greatest(F.lit(0), whole(F.least("y0", "y1")))
    own = paragraphs.withColumn("text", ocr_text(F.col("text")))
    own = own.withColumns({"x": x, "y": y, "width": F.greatest(F.lit(24), whole(F.abs(F.col("x1") - F.col("x0")))), "height": F.greatest(F.lit(24), whole(F.abs(F.col("y1") - F.col("y0")))), "type": ocr_type(F.col("text"))})
    own = own.select("doc_id", "page_number", "block_seq", "par_seq", "type", "text", "x", "y", "width", "height", "confidence")
    names = [c.split()[0] for c in OCR.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 5]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, page in whole_pages(batches, ["block_seq", "par_seq"] if together else []):
            for batch in _read(rows, page, tolerance).select(names).cast(pa.schema(dict(zip(names, types, strict=True)))).to_batches(max_chunksize=10_000):
                yield batch

    return (own if together else in_pages(own, "block_seq", "par_seq")).mapInArrow(order, OCR)


def ocr_document(pages: DataFrame) -> DataFrame:
    """Per document of OCR blocks: confidence (mean of page means), characters, readable and fragile flags."""
    page = pages.groupBy("doc_id", "page_number").agg(F.avg("confidence").alias("c"), F.sum(F.length("text")).alias("chars"))
    out = page.groupBy("doc_id").agg(F.avg("c").alias("confidence"), F.sum("chars").alias("chars"))
    return out.withColumns({"readable": F.col("chars") >= 20, "fragile": (F.col("confidence") < 55) | (F.col("chars") < 120)})


def adopt(previous_quality, previous_is_ocr, previous_chars, quality, confidence, chars):
    """Whether an OCR result replaces what there is."""
    plain_good = ~previous_is_ocr & (previous_quality == "good")
    return (quality != "poor") & (previous_quality.isNull() | ~plain_good | ((confidence >= 78) & (chars >= F.greatest(previous_chars * 0.92, previous_chars - 80))))


def heading_islands(own: DataFrame, keys: list[str], order_col: str, continues) -> DataFrame:
    """Adjacent headings of which one goes on from the other, as one: gaps and islands over a page."""
    order = Window.partitionBy(*keys).orderBy(order_col)
    flag = F.coalesce(continues(F.lag("text").over(order), F.col("text")) & (F.col("type") == "heading") & (F.lag("type").over(order) == "heading"), F.lit(False))
    marked = own.withColumn("island", F.sum(F.when(flag, 0).otherwise(1)).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, "text"))), lambda x: x["text"]), " ")
    return marked.groupBy(*keys, "island").agg(joined.alias("text"), F.min_by("type", order_col).alias("type"))
