"""Positioned spans into lines, panels, cells and tables, and boxes into decisions.

A span has page, x, y (upwards), width, font_size, rotation and text. What depends on a running state (which line, panel
or cell a span belongs to) is an ordered scan (``scans``); the rest are column expressions, joins and grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import vocabulary as V
from labelloom.functions.arrays import let
from labelloom.operators.joins import box_overlaps
from labelloom.operators.scans import dealt, line_numbers, lined, lines_of, medians, previous, running, sessions_by_gap
from labelloom.operators.shared import by_size, connected, cut, drop, joined, ranked

SETTLED = 200_000  # overlaps of boxes that one task settles
PAGE_BOXES = 2048  # boxes of a page that are compared in one group
PAIRS = 1 << 18  # pairs of such boxes that are compared at a time


def from_matrix(runs: DataFrame) -> DataFrame:
    """Glyph runs with a text matrix (a, b, x, y) as spans: the font size is the length of (a, b), the rotation its angle."""
    return runs.withColumns({"font_size": F.hypot("a", "b"), "rotation": F.atan2("b", "a")}).drop("a", "b")


def rotated(spans: DataFrame) -> DataFrame:
    """along and cross coordinates and a rotation bucket of 0.01 rad."""
    r = F.col("rotation")
    along = F.col("x") * F.cos(r) + F.col("y") * F.sin(r)
    cross = -F.col("x") * F.sin(r) + F.col("y") * F.cos(r)
    return spans.withColumns({"along": along, "cross": cross, "bucket": F.round(r / 0.01).cast("long")})


def panels(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Band of each span along the axis: a gap above 1.5 median font sizes starts a new panel."""
    sizes = medians(spans, keys, "font_size").select(*keys, F.col("median").alias("__m"))
    placed = joined(spans, sizes, keys).withColumn("__end", F.col("along") + F.col("width"))
    return sessions_by_gap(placed, keys, "along", "__end", F.col("__m") * 1.5).drop("__m", "__end")


def lines(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text, cross, font_size, n): spans grouped to lines from the top down, words from left to right.

    Spans of one height go by their font size, larger ones first.
    """
    rows = spans.select(*keys, "along", "cross", "font_size", "text")

    def texts(placed: DataFrame) -> DataFrame:
        largest = lambda name: F.array_max(F.col(f"rows.{name}")).alias(name)
        words = F.array_join(F.sort_array(F.transform("rows", lambda x: F.struct(x["along"], x["text"])))["text"], " ")
        return placed.select(*keys, "line", words.alias("text"), largest("cross"), largest("font_size"), F.size("rows").cast("long").alias("n"))

    place = (rows, keys, F.col("cross"), F.col("font_size"), "line")
    if [rows.schema[c].dataType.typeName() for c in rows.columns[-4:]] != ["double", "double", "double", "string"]:  # other numbers are reckoned by Spark
        return texts(lined(*place))
    kinds = {"text": T.StringType(), "cross": T.DoubleType(), "font_size": T.DoubleType(), "n": T.LongType()}
    return lines_of(*place, ["along", "text"], line_texts, [T.StructField(c, k) for c, k in kinds.items()], texts)


def line_texts(words: pa.Table, starts: np.ndarray, u: np.ndarray, w: np.ndarray) -> pa.Table:
    """The lines of words (keys, along, text, line) that go by lines: their words from left to right, unknown places
    first and NaN last, then by text; the largest of the places, which are negated; the number of words."""
    n, along = np.diff(np.append(starts, words.num_rows)), words["along"]
    nan = pc.fill_null(pc.is_nan(along), False)
    order = {"line": pa.array(np.repeat(starts, n)), "known": along.is_valid(), "nan": nan, "along": pc.if_else(nan, 0.0, pc.fill_null(along, 0.0)), "text": words["text"]}
    text = words["text"].take(pc.sort_indices(pa.table(order), sort_keys=[(c, "ascending") for c in order]))
    ends = np.append(0, np.cumsum(np.add.reduceat(np.asarray(text.is_valid()).astype("int32"), starts)))
    joined_ = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text.drop_null().combine_chunks()), " ")
    lines_ = words.drop_columns(["along", "text"]).take(pa.array(starts)).append_column("text", joined_)
    return lines_.append_column("cross", pa.array(np.maximum.reduceat(-u, starts))).append_column("font_size", pa.array(np.maximum.reduceat(-w, starts))).append_column("n", pa.array(n))


def reading_text(lines_: DataFrame, page: str, panel: str) -> DataFrame:
    """Text of each page: lines with line ends, panels with a blank line between."""
    by_panel = lines_.groupBy(page, panel).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return by_panel.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(panel, "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def cells(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of each line: a gap above 1.5 font sizes of the line from the span before starts a new one."""
    order = ["along", "text", "width"]
    placed = dealt(joined(spans, spans.groupBy(*keys).agg(F.max("font_size").alias("__f")), keys), keys, order)
    behind = previous(placed, keys, order, F.col("along") + F.col("width"), "__q")
    opens = F.when(F.col("__q").isNull() | (F.col("along") - F.col("__q") > 1.5 * F.col("__f")), 1).otherwise(0)
    flagged = cut(behind.withColumn("__new", opens), "cells")
    numbered = running(flagged, keys, order, "__new", F.sum, "cell", inclusive=True)
    return numbered.groupBy(*keys, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("along", "text"))), lambda x: x["text"]), " ").alias("text"))


def display_lines(lines_: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """Lines of 2.5 median font sizes with a letter, largest first, each text once, ``top`` of a page (part of the feature)."""
    lines_ = cut(lines_, "lines")
    large = joined(lines_, medians(lines_, keys, "font_size"), keys).where((F.col("font_size") >= 2.5 * F.col("median")) & F.col("text").rlike(r"\p{L}"))
    once = large.groupBy(*keys, "text").agg(F.max(F.struct("font_size", "cross")).alias("b"))
    order = Window.partitionBy(*keys).orderBy(F.desc("b"), "text")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*keys, "text", "b.font_size", "rank")


def clustered_rows(words: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Row of each word: within ``tolerance`` of the row's first word, from the top. That is a line whose sizes all are
    twice the tolerance."""
    return line_numbers(words, keys, -F.col("y0"), F.lit(2.0 * tolerance), "row").select(*words.columns, "row")


def _settled(links: DataFrame, group: list[str]) -> DataFrame:
    """(page, id) of the boxes that go, among links (page, u, v) from better to worse boxes; a group is settled in one
    pass, by rank: a box that no kept one overlaps takes those that it overlaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for u, v in sorted(zip(pdf["u"], pdf["v"], strict=True)):
            if u not in gone:
                gone.add(v)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "id": sorted(gone)})

    return links.groupBy(*group).applyInPandas(run, f"page {links.schema['page'].dataType.simpleString()}, id long")


def _peeled(links: DataFrame) -> list[DataFrame]:
    """The same in rounds: boxes that nothing better overlaps stay and take what they overlap with them, until no link
    is left to decide."""
    gone = []
    while not links.isEmpty():
        free = links.select("page", "u").distinct().join(links.select("page", F.col("v").alias("u")).distinct(), ["page", "u"], "left_anti")
        out = cut(links.join(free, ["page", "u"]).select("page", F.col("v").alias("id")).distinct(), "gone")
        gone.append(out)
        left = links.join(free, ["page", "u"], "left_anti")
        for end in ("u", "v"):
            left = left.join(out.withColumnRenamed("id", end), ["page", end], "left_anti")
        last, links = links, cut(left, "overlaps")
        drop(last)
    return gone


def without_overlaps(lines_: DataFrame, page: str, limit: float = 0.7, cell: float = 64.0) -> DataFrame:
    """Lines of a page by confidence, then from the top; one that overlaps a kept line by more than ``limit`` goes.

    Of equal boxes the best stays. Boxes of a page of up to PAGE_BOXES meet in one group after one shuffle (``_page_kept``),
    those of larger pages in grid cells (``_spread_kept``).
    """
    few, many = by_size(lines_, [page], PAGE_BOXES)
    double = all(few.schema[c].dataType.typeName() == "double" for c in ("x0", "y0", "x1", "y1"))  # other numbers are reckoned by Spark
    kept = _page_kept(few, page, limit) if double else _spread_kept(few, page, limit, cell)
    if many is not None:
        kept = kept.unionByName(_spread_kept(many, page, limit, cell))
    return kept.select(*[F.col(c) if c in (page, "x0", "y0", "x1", "y1") else F.col(f"r.{c}").alias(c) for c in lines_.columns])


def _best_of_equal(lines_: DataFrame, page: str) -> DataFrame:
    """(page, box, r): of equal boxes the other columns of the best."""
    names = [page, "x0", "y0", "x1", "y1"]
    rest = F.struct(*[c for c in lines_.columns if c not in names])
    return lines_.groupBy(*names).agg(F.min_by(rest, F.struct(-F.col("confidence"), "text")).alias("r"))


def _by_rank() -> list[Column]:
    return [-F.col("r.confidence"), F.col("y0"), F.col("x0"), F.col("r.text"), F.col("x1"), F.col("y1")]


def _page_kept(lines_: DataFrame, page: str, limit: float) -> DataFrame:
    """(page, box, r) of the boxes that stay, of pages that are held by a group each. Rows are sorted once, by rank; the
    best of equal boxes is the first of them."""
    box = ("x0", "y0", "x1", "y1")
    rest = F.struct(*[c for c in lines_.columns if c != page and c not in box])
    dealt_ = lines_.repartition(F.col(page)).select(page, *[(F.col(c) + 0.0).alias(c) for c in box], rest.alias("r"))  # no -0.0, as in groups
    placed = dealt_.withColumn("__rank", F.row_number().over(Window.partitionBy(page).orderBy(*_by_rank())))

    def run(boxes: pa.Table) -> pa.Table:
        boxes = boxes.sort_by("__rank")
        sides = [boxes[c].to_numpy() for c in box]
        kept = first_of_equal([*sides, *[boxes[c].is_null().to_numpy() for c in box if boxes[c].null_count]])
        if not boxes[page].null_count:  # boxes without a page meet no others
            kept[kept] = kept_boxes(*[s[kept] for s in sides], limit)
        return boxes.filter(pa.array(kept))

    return placed.groupBy(page).applyInArrow(run, placed.schema).drop("__rank")


def first_of_equal(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows are the first of those with their values. Unknown numbers are equal."""
    order, new = np.lexsort(columns), np.arange(len(columns[0])) == 0
    for c in columns:
        a, b = c[order[:-1]], c[order[1:]]
        new[1:] |= (a != b) & ~(np.isnan(a) & np.isnan(b))
    out = np.zeros(len(order), dtype=bool)
    out[order[new]] = True
    return out


def kept_boxes(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes, from the best to the worst, no kept one overlaps by more than ``limit``. Pairs come from a sweep along
    the axis on which fewer boxes share a place; a box with an unknown side overlaps none."""

    def sweep(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(low, kind="stable")  # unknown ones last
        behind = np.searchsorted(low[order], high[order]) - np.arange(1, len(low) + 1)
        return order, np.where(np.isnan(high[order]), 0, np.maximum(behind, 0))

    order, behind = min(sweep(x0, x1), sweep(y0, y1), key=lambda s: s[1].sum())
    total, area, links = np.concatenate([[0], np.cumsum(behind)]), (x1 - x0) * (y1 - y0), []
    for start in range(0, int(total[-1]), PAIRS):
        pair = np.arange(start, min(start + PAIRS, total[-1]))
        first = np.searchsorted(total, pair, side="right") - 1
        a, b = order[first], order[first + 1 + pair - total[first]]
        width = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b])
        height = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
        a, b, both = (v[(width > 0) & (height > 0)] for v in (a, b, width * height))
        u, v = np.minimum(a, b), np.maximum(a, b)
        far = both / (area[u] + area[v] - both) > limit
        links.append(np.stack([u[far], v[far]]).astype("int32"))
    kept = np.ones(len(x0), dtype=bool)
    if links:
        u, v = np.concatenate(links, axis=1)
        better = np.argsort(u, kind="stable")
        u, v = u[better], v[better]
        ends, starts = np.unique(u, return_index=True)
        for i, start, end in zip(ends, starts, np.append(starts, len(u))[1:], strict=True):
            if kept[i]:
                kept[v[start:end]] = False
    return kept


def _spread_kept(lines_: DataFrame, page: str, limit: float, cell: float) -> DataFrame:
    """(page, box, r) of the boxes that stay, of pages of any size. Boxes meet in grid cells, by rank. Pages of up to
    SETTLED overlaps are settled in one task each, larger ones by components of overlapping boxes, and only components
    beyond that in rounds.
    """
    best = _best_of_equal(lines_, page).withColumn("__id", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(_by_rank())]))
    best = cut(ranked(best, [page], ["__id"], "__rank").drop("__id"), "boxes")
    sides = best.select(F.col(page).alias("page"), F.col("__rank").alias("id"), "x0", "y0", "x1", "y1")
    met = box_overlaps(sides, sides, "page", cell).where((F.col("a_id") < F.col("b_id")) & (F.col("iou") > limit) & ~F.isnan("iou"))
    links = cut(met.select("page", F.col("a_id").alias("u"), F.col("b_id").alias("v")), "overlaps")
    crowded = cut(links.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > SETTLED).select("page"), "crowded")
    gone = [_settled(links.join(crowded, "page", "left_anti"), ["page"])]
    if not crowded.isEmpty():
        inside = links.join(crowded, "page", "left_semi")
        node = lambda end: F.struct("page", F.col(end).alias("id"))
        label = connected(inside.select(node("u").alias("a"), node("v").alias("b"))).select(F.col("a.page").alias("page"), F.col("a.id").alias("u"), F.col("l.id").alias("part"))
        parts = cut(inside.join(label, ["page", "u"]), "parts")
        large = parts.groupBy("page", "part").agg(F.count("*").alias("n")).where(F.col("n") > SETTLED).select("page", "part")
        gone.append(_settled(parts.join(large, ["page", "part"], "left_anti"), ["page", "part"]))
        gone += _peeled(cut(parts.join(large, ["page", "part"], "left_semi").drop("part"), "overlaps"))
    for out in gone:
        best = best.join(out.select(F.col("page").alias(page), F.col("id").alias("__rank")), [page, "__rank"], "left_anti")
    return best.drop("__rank")


def pixel_box(x: Column, y: Column, width: Column, size: Column, page_height: Column, dpi: int = 300) -> Column:
    """Rectangle of an upright span in pixels, with y downwards."""
    k = dpi / 72
    return F.struct((x * k).alias("x0"), ((page_height - y - size) * k).alias("y0"), ((x + width) * k).alias("x1"), ((page_height - y) * k).alias("y1"))


def quarter_turned(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, degrees: int) -> Column:
    """A box read on a page turned by 90 or 270 degrees, on the page as it was."""
    if degrees == 90:
        return F.struct(y0.alias("x0"), (height - x1).alias("y0"), y1.alias("x1"), (height - x0).alias("y1"))
    return F.struct((width - y1).alias("x0"), x0.alias("y0"), (width - y0).alias("x1"), x1.alias("y1"))


def is_display_text(text: Column) -> Column:
    """Three letters, at most six words, a fifth of odd characters and two words with digits."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s&'.-]", ""))
    return (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3) & (F.size(words) <= 6) & (odd <= 0.2 * F.length(text)) & (F.size(F.filter(words, lambda w: w.rlike(r"\d"))) <= 2)


def is_trustworthy_addition(current: Column, new: Column) -> Column:
    """A strict superset of the current words, of eight words at most."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    a, b = words(current), words(new)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(b) > F.size(a)) & (F.size(b) <= 8)


def covered(boxes: DataFrame, overlaps: DataFrame, key: str) -> DataFrame:
    """Share of each box that overlaps (key, area) cover, at most 1."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sums = overlaps.groupBy(key).agg(F.sum("area").alias("__a"))
    return boxes.join(sums, key, "left").select(key, F.least(F.lit(1.0), F.coalesce(F.col("__a"), F.lit(0.0)) / F.nullif(area, F.lit(0.0))).alias("coverage"))


def strips(intervals: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Merged intervals: ones that overlap or lie within ``gap`` become one."""
    banded = sessions_by_gap(intervals, keys, start, end, F.lit(gap))
    return banded.groupBy(*keys, "band").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("band")


def prominent_word(words: DataFrame, keys: list[str], forms: str) -> DataFrame:
    """The tallest confident form word of a page that stands 1.6 median heights tall."""
    sized = words.withColumn("__h", F.col("y1") - F.col("y0"))
    tall = joined(sized, medians(sized, keys, "__h"), keys).where((F.col("confidence") >= 60) & (F.col("__h") >= 1.6 * F.col("median")) & F.lower("text").rlike(f"^(?:{forms})$"))
    return tall.groupBy(*keys).agg(F.max_by("text", F.struct("__h", "text")).alias("text"))


AMOUNT = re.compile(r"^[<>≤≥~]?\s*\d")
HEADER = re.compile(rf"\b{V.any_of(V.NUTRITION_HEADS)}\b", re.I)
STOP = re.compile(rf"^\s*{V.any_of(V.NUTRITION_ENDS)}\b", re.I)
ROWS = 40


def nutrition_rows(lines_: list[list[str]]) -> dict[str, str]:
    """Nutrient amounts of the lines (as cells) after the first header: two cells, one cell with its amount, five or
    six cells as two groups, or a third cell of percent, which is dropped. The first row of a name wins."""
    out: dict[str, str] = {}
    begin = next((i for i, cells_ in enumerate(lines_) if HEADER.search(" ".join(cells_))), None)
    if begin is None:
        return out
    for cells_ in lines_[begin + 1 : begin + 1 + ROWS]:
        if STOP.match(" ".join(cells_)):
            break
        groups = [cells_]
        if len(cells_) >= 5:
            half = (len(cells_) + 1) // 2
            groups = [cells_[:half], cells_[half:]]
        for g in groups:
            if len(g) == 1 and (m := re.match(r"^(.*?[A-Za-z0-9)])\s+([<>≤≥~]?\s*\d.*)$", g[0])):
                g = [m[1], m[2]]
            if len(g) >= 2 and AMOUNT.match(g[1]) and len(re.sub(r"\([^)]*\)$", "", g[0]).split()) <= 3:
                out.setdefault(g[0].strip(), g[1].strip())
    return out


def nutrition_tables(cells_: DataFrame, key: str) -> DataFrame:
    """(key, nutrition map) of cells (key, line, cell, text): of the ROWS lines behind the first header alone, so that a
    page's task holds no more. A page without a header has an empty map."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"])
    rows = cut(cells_.groupBy(key, "line").agg(listed.alias("cells")), "lines")
    head = F.array_join("cells", " ").rlike(f"(?i){HEADER.pattern}")
    heads = cut(rows.groupBy(key).agg(F.min(F.when(head, F.col("line"))).alias("head")), "heads")
    behind = rows.join(heads, key).where(F.col("line") > F.col("head"))
    order = Window.partitionBy(key).orderBy("line")
    few = behind.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ROWS)
    tables = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "cells"))), lambda x: x["cells"]).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(nutrition_rows([["nutrition facts"], *lines_]).items()) for lines_ in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.map_(pa.string(), pa.string()))], [key, "nutrition"])

    kind = cells_.schema[key].dataType.simpleString()
    pairs = tables.mapInArrow(run, f"`{key}` {kind}, nutrition map<string,string>")
    return heads.select(key).join(pairs, key, "left").select(key, F.coalesce("nutrition", F.create_map().cast("map<string,string>")).alias("nutrition"))


def filled_grid(at: Column, size: int) -> Column:
    """Array of ``size`` numbers of the entries (p, v) that ``at`` lists by rising p from 0 on, 0 elsewhere. Zeros are put
    in front of each entry and behind the last, so the work grows with the array, not with entries times size."""
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))

    def of(entries: Column) -> Column:
        ended = lambda i: F.coalesce(F.get(entries, i)["p"], F.lit(-1))
        parts = F.transform(entries, lambda x, i: F.concat(zeros(x["p"] - F.when(i > 0, ended(i - 1)).otherwise(-1) - 1), F.array(x["v"])))
        return F.concat(F.flatten(parts), zeros(size - 1 - ended(F.size(entries) - 1)))

    return let(at, of)


def _runs(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of a boolean grid's rows, in order."""
    edge = np.diff(np.pad(grid.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return row, start, end


def components(grid: np.ndarray) -> np.ndarray:
    """Labels of 4-neighbour regions of a boolean grid, 0 outside; each the smallest position plus one.

    Runs of cells are joined to the runs that they touch in the row above (union-find), so the work grows with the
    cells, however long a region winds.
    """
    row, start, end = _runs(grid)
    wide = grid.shape[1] + 1
    above = (row - 1) * wide
    first = np.searchsorted(row * wide + end, above + start, side="right")
    last = np.searchsorted(row * wide + start, above + end, side="left")
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, (low, high) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for j in range(low, high):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(row))], dtype=np.int64)
    out = np.zeros(grid.size, dtype=np.int64)
    names = (row * grid.shape[1] + start + 1)[roots] if len(roots) else roots
    out[np.flatnonzero(grid)] = np.repeat(names, end - start)
    return out.reshape(grid.shape)


def ink_regions(images: DataFrame, key: str, cells_: str, width: int = 64, ink: int = 12, top: int = 3, covered: str | None = None) -> DataFrame:
    """(key, rank, mass, share): the ``top`` connected regions of inked cells whose area is 0.4 % to 40 % of the grid.
    Cells that ``covered`` (an array of booleans) names belong to words already read and to no region."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, values, hidden in zip(pdf[key], pdf[cells_], pdf["__covered"], strict=True):
                grid = np.asarray(values).reshape(-1, width)
                inked = grid >= ink
                if hidden is not None:
                    inked &= ~np.asarray(hidden, dtype=bool).reshape(-1, width)
                names, region = np.unique(components(inked)[inked], return_inverse=True)
                shares = np.bincount(region, minlength=len(names)) / grid.size
                masses = np.zeros(len(names), dtype=np.int64)
                np.add.at(masses, region, grid[inked].astype(np.int64))
                fit = np.flatnonzero((shares >= 0.004) & (shares <= 0.4))
                best = fit[np.lexsort((names[fit], -masses[fit]))][:top]
                rows += [(k, i + 1, int(masses[b]), float(shares[b])) for i, b in enumerate(best)]
            yield pd.DataFrame(rows, columns=[key, "rank", "mass", "share"])

    hidden = F.col(covered) if covered else F.lit(None).cast("array<boolean>")
    return images.select(key, cells_, hidden.alias("__covered")).mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, rank int, mass long, share double")
