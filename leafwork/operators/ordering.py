"""Order of items on a page, lines of words, column anchors, splits of streams: windows over explicit ordinals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.operators.segments import by_group, heads, running_max

WIDE, COLUMN_SLACK, ANCHOR_GAP = 0.6, 2.0, 8.0


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows from 0: a run starts where ``starts`` holds, and at the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def bands(items: DataFrame, keys: list[str], x0: str = "rx0", x1: str = "rx1", tie: str = "item_no") -> DataFrame:
    """Bands of a region: an item of 60 % of its width or more stands alone between two bands. Adds wide, band."""
    wide = (F.col("x1") - F.col("x0")) >= WIDE * F.greatest(F.lit(1.0), F.col(x1) - F.col(x0))
    w = Window.partitionBy(*keys).orderBy("y0", "x0", tie).rowsBetween(Window.unboundedPreceding, 0)
    own = items.withColumn("wide", wide)
    return own.withColumn("band", F.sum(F.col("wide").cast("int") * 2).over(w) - F.col("wide").cast("int"))


def columns(items: DataFrame, keys: list[str], tie: str = "item_no") -> DataFrame:
    """Columns of a band, from 0 at the left: a column starts where an item lies right of all before it."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1", tie)
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(items, keys, ["x0", "x1", tie], F.col("x0") > reach + COLUMN_SLACK, "col")


def region_order(region: np.ndarray, x0: np.ndarray, x1: np.ndarray, sides: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Rows in reading order within each of many regions at once, pages for instance, whose order stays.

    Rows come by region, and in it from the top, then from the left. A region is cut into bands at its wide items,
    and a band into columns, which are regions again, until a band is one column: that reads as it came. All regions
    that are still open are segments of one array and are cut together, by one sort and one running maximum a level,
    so the number of passes is the depth of the deepest nesting. ``sides`` tells left and right of the first regions.
    """
    order = np.arange(len(region))
    slots, own = order.copy(), region
    while len(slots):
        rows, first = order[slots], heads(own)
        size = np.diff(np.append(first, len(own)))
        at = np.repeat(np.arange(len(first)), size)
        left, right, width = x0[rows], x1[rows], x1[rows] - x0[rows]
        lo, hi = (np.minimum.reduceat(left, first), np.maximum.reduceat(right, first)) if sides is None else sides
        sides = None
        wide = width >= WIDE * np.maximum(1.0, hi - lo)[at]
        count = np.cumsum(wide)
        band = 2 * (count - (count - wide)[first][at]) - wide
        cut = np.append(True, (at[1:] != at[:-1]) | (band[1:] != band[:-1]))
        band = np.cumsum(cut) - 1
        by = np.lexsort((right, left, band))
        reach = running_max(band[by], right[by])
        new = np.append(True, (band[by][1:] != band[by][:-1]) | (left[by][1:] > reach[:-1] + COLUMN_SLACK))
        column = np.empty(len(rows), np.int64)
        column[by] = np.cumsum(new) - 1
        columns_of = np.bincount(band[by][new])
        again = np.argsort(column, kind="stable")  # each column from the top again
        order[slots] = rows[again]
        column = column[again]
        open_ = (columns_of[band[again]] > 1) & (np.bincount(column)[column] > 1)
        slots, own = slots[open_], column[open_]
    return order


def page_order(rects: np.ndarray, x0: float | None = None, x1: float | None = None) -> list[int]:
    """Rows of an array of rectangles in reading order, in a region as wide as all or as told."""
    top = np.lexsort((rects[:, 0], rects[:, 1]))
    sides = None if x0 is None or x1 is None else (np.array([x0], float), np.array([x1], float))
    return top[region_order(np.zeros(len(top), np.int64), rects[top, 0], rects[top, 2], sides)].tolist()


def reading_order(items: DataFrame, keys: list[str], tie: str = "item_no") -> DataFrame:
    """Items with ``place``, their rank in reading order on the page; of equal places the smaller ``tie`` goes first.

    How deep columns nest isn't known beforehand, so pages, dealt and sorted by Spark, are ordered as segments of
    Arrow batches; a page with coordinates that are null or not finite keeps those items behind all others.
    """
    schema = T.StructType([*(f for f in items.schema if f.name != "place"), T.StructField("place", T.IntegerType())])
    sides = ("x0", "y0", "x1", "y1")

    def run(b: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        x0, y0, x1, y1 = (pc.fill_null(b.column(c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in sides)
        good = np.isfinite(x0 + y0 + x1 + y1)
        rows = np.arange(len(page))
        ordered = rows[good][region_order(page[good], x0[good], x1[good])]
        rows = np.concatenate([ordered, np.flatnonzero(~good)])
        rows = rows[np.argsort(page[rows], kind="stable")]
        place = np.empty(len(rows), np.int32)
        place[rows] = np.arange(len(rows)) - heads(page)[page] + 1
        return pa.record_batch([*b.columns, pa.array(place)], names=schema.names)

    return by_group(items.select([f.name for f in schema][:-1]), keys, ["y0", "x0", tie], run, schema)


def join_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Text of lines from their spans: soft hyphens go, and a gap over a fifth of the size parts words."""
    w = Window.partitionBy(*keys).orderBy("span_no")
    own = spans.withColumn("t", F.replace("text", F.lit("­"), F.lit(""))).where("t <> ''")
    before, end = F.lag("t").over(w), F.lag("x1").over(w)
    gap = (F.col("x0") - end > 0.2 * F.col("size")) & ~F.endswith(before, F.lit(" ")) & ~F.startswith("t", F.lit(" "))
    own = own.withColumn("piece", F.concat(F.when(F.coalesce(gap, F.lit(False)), " ").otherwise(""), F.col("t")))
    pieces = F.sort_array(F.collect_list(F.struct("span_no", "piece")))
    return own.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("line"))


def split_cells(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of lines: a new one where the gap is a whole size or more; text with single blanks."""
    w = Window.partitionBy(*keys).orderBy("span_no")
    own = spans.where(F.trim("text") != "")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = islands(own, keys, ["span_no"], F.col("x0") - reach >= F.col("size"), "cell")
    pieces = F.sort_array(F.collect_list(F.struct("span_no", "text")))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda p: p.text), " "), r"\s+", " "))
    return cells.groupBy(*keys, "cell").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.every("bold").alias("bold"))


def floats(column: pa.Array) -> np.ndarray:
    """Numbers as doubles, null as NaN."""
    return pc.fill_null(column.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def typed(df: DataFrame, names: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in names), *T._parse_datatype_string(more)])


def anchors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Column anchors: means of left sides that follow one another within 8 points, numbered from the left.

    Sides are dealt and sorted by Spark, once; runs of them are segments of arrays.
    """
    schema = typed(cells, keys, "anchor long, ax double")

    def run(b: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        x = floats(b.column("x0"))
        with np.errstate(invalid="ignore"):
            first = np.append(True, (page[1:] != page[:-1]) | ~(np.diff(x) <= ANCHOR_GAP))
            at = np.flatnonzero(first)
            ax = np.add.reduceat(x, at) / np.diff(np.append(at, len(x)))
        own = page[at]
        number = np.arange(len(at)) - heads(own)[own]
        told = pa.array(ax, mask=pc.is_null(b.column("x0")).to_numpy(zero_copy_only=False)[at])
        return pa.record_batch([*(b.column(k).take(pa.array(at)) for k in keys), pa.array(number, pa.int64()), told], names=schema.names)

    return by_group(cells.select(*keys, "x0"), keys, ["x0"], run, schema)


def nearest_anchor(cells: DataFrame, found: DataFrame, keys: list[str], cell_id: str) -> DataFrame:
    """For each cell the nearest anchor, the first of equals; a cell whose side is unknown has the page's first, one without anchors no row.

    Cells and anchors of a page are sorted together by place, so the nearest is the last anchor before a cell or the next
    one behind it: no cell is paired with all anchors.
    """
    schema = typed(cells, [*keys, cell_id], "anchor long")
    mark = found.select(*keys, F.lit(None).cast(cells.schema[cell_id].dataType).alias(cell_id), F.col("ax").alias("x"), F.col("anchor").cast("long").alias("anchor"))
    both = cells.select(*keys, cell_id, F.col("x0").cast("double").alias("x"), F.lit(None).cast("long").alias("anchor")).unionByName(mark)

    def run(b: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        x, number = floats(b.column("x")), pc.fill_null(b.column("anchor"), -1).to_numpy(zero_copy_only=False)
        is_anchor, at = number >= 0, np.arange(len(x))
        least = np.full(page[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, page[is_anchor], number[is_anchor])
        # of anchors at one place the first counts: anchors come by number, and the later ones are passed over
        use = np.flatnonzero(is_anchor & ~np.isnan(x))
        use = use[np.lexsort((number[use], x[use], page[use]))]
        use = use[np.append(True, (page[use][1:] != page[use][:-1]) | (x[use][1:] != x[use][:-1]))] if len(use) else use
        cell = np.flatnonzero(~is_anchor & (least[page] < np.iinfo(np.int64).max))
        best, away = least[page[cell]], np.full(len(cell), np.inf)
        if len(use):
            # rows are in order of page and place, so ranks of anchors are found by the place of rows
            k = np.searchsorted(use, cell)
            for side in (k - 1, k):
                other = use[np.clip(side, 0, len(use) - 1)]
                d = np.where((side >= 0) & (side < len(use)) & (page[other] == page[cell]), np.abs(x[cell] - x[other]), np.inf)
                nearer = (d < away) | (d == away) & np.isfinite(d) & (number[other] < best)
                best, away = np.where(nearer, number[other], best), np.where(nearer, d, away)
        ids = b.column(cell_id).take(pa.array(at[cell]))
        rank = pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((best, away, rank, page[cell]))
        own, r = page[cell][order], rank[order]
        order = order[np.append(True, (own[1:] != own[:-1]) | (r[1:] != r[:-1]))] if len(order) else order
        rows = pa.array(cell[order])
        return pa.record_batch([*(b.column(c).take(rows) for c in (*keys, cell_id)), pa.array(best[order], pa.int64())], names=schema.names)

    return by_group(both, keys, ["x", "anchor"], run, schema)


def split_by_heading(blocks: DataFrame, doc: str, level: int) -> DataFrame:
    """Journal pages of a document's blocks (ord, kind, text): a heading of the level or above starts one. Adds jpage."""
    starts = F.col("kind").isin(*(f"h{k}" for k in range(1, level + 1)))
    w = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("jpage", F.sum(starts.cast("int")).over(w))


def list_groups(blocks: DataFrame, doc: str) -> DataFrame:
    """Runs of list items of one kind: doc, grp, ordered, items (texts in order)."""
    w = Window.partitionBy(doc).orderBy("ord")
    is_item = F.col("kind") == "li"
    starts = ~(is_item & (F.lag("kind").over(w) == "li") & (F.lag("ordered").over(w) == F.col("ordered")))
    runs = islands(blocks, [doc], ["ord"], starts, "grp").where(is_item)
    return runs.groupBy(doc, "grp", "ordered").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x.text).alias("items"))


def sheets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """By block whether it is a sheet: two lines or more, and 40 % of them, look like ``Label: value``."""
    label = F.trim("text").rlike(r"^[A-ZÀ-Ý][\wÀ-ÿ%/()' -]{1,32}:\s*\S")
    told = lines.groupBy(*keys).agg(F.count_if(label).alias("labels"), F.count("*").alias("lines"))
    return told.withColumn("sheet", (F.col("labels") >= 2) & (F.col("labels") >= 0.4 * F.col("lines")))


def first_disjoint(spans: Column) -> Column:
    """Of spans (s, e, ...) in order of precedence those that meet none accepted before, sorted by place."""
    none = F.slice(spans, F.lit(1), F.lit(0))
    taken = F.aggregate(spans, none, lambda acc, x: F.when(F.exists(acc, lambda a: ~((x.e <= a.s) | (x.s >= a.e))), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(taken, lambda a, b: F.when(a.s < b.s, -1).when(a.s > b.s, 1).otherwise(0))


def without_overlap(spans: Column, others: Column) -> Column:
    """Spans that meet none of the others."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda a: ~((x.e <= a.s) | (x.s >= a.e))))


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (s, e from 0, rep) replaced; spans are disjoint and sorted."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, lambda acc, x: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x.s - acc["at"]), x.rep).alias("out"), x.e.alias("at")))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
