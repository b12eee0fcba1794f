"""Filters and joins on rectangles of a page: images, boxes, tables, memberships.

Every join deals rectangles to the cells of a grid of their page (``spatial``), so that pairs are those of
neighbours, on crowded pages too. Items are told apart by ``item_no``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.geometry import Rect, belongs, holds, overlap
from leafwork.operators.spatial import OTHER, SIDES, counted, meetings, without
from leafwork.storage import saved

KEYS = ["book_id", "page_no"]
def _other() -> Rect:
    return Rect(OTHER)


def clip(df: DataFrame, page: tuple[float, float, float, float]) -> DataFrame:
    lo, hi = F.greatest, F.least
    return df.withColumns({"x0": lo("x0", F.lit(page[0])), "y0": lo("y0", F.lit(page[1])), "x1": hi("x1", F.lit(page[2])), "y1": hi("y1", F.lit(page[3]))})


def not_covered(items: DataFrame, by: DataFrame, share: float, keys: list[str] = KEYS) -> DataFrame:
    """Items of which no rectangle of the page covers more than a share."""
    return without(items, by, overlap(Rect(), _other()) > share * Rect().area, keys)


def outside(items: DataFrame, rects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Items whose centre lies in none of the rectangles."""
    return without(items, rects, holds(_other(), Rect().cx, Rect().cy), keys, grow=1.0)


def image_candidates(images: DataFrame, tables: DataFrame, texts: DataFrame, page: tuple[float, float, float, float], least: float = 48.0, keys: list[str] = KEYS) -> DataFrame:
    """Images that may be illustrations: on the page, large and compact enough, not a table, no margin ornament."""
    r = Rect()
    own = clip(images, page).where((r.width >= least) & (r.height >= least) & (F.greatest(r.width, r.height) <= 6 * F.least(r.width, r.height)))
    own = not_covered(own, tables, 0.5, keys)
    content = texts.groupBy(*keys).agg(*(f(c).alias("c_" + c) for f, c in zip((F.min, F.min, F.max, F.max), SIDES, strict=True)))
    own = own.join(content, keys, "left").withColumns({"c_" + c: F.coalesce("c_" + c, F.lit(v)) for c, v in zip(SIDES, page, strict=True)})
    area = (page[2] - page[0]) * (page[3] - page[1])
    return own.where(~((r.area < 0.06 * area) & (overlap(r, Rect("c_")) < 0.3 * r.area))).drop(*("c_" + c for c in SIDES))


def backgrounds(images: DataFrame, texts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Images under text: more than 300 characters in all, or 80 in one, at least half covered."""
    pairs = meetings(images, texts, overlap(_other(), Rect()) >= 0.5 * _other().area, keys, more=("chars",))
    return pairs.groupBy(*keys, "item_no").agg(F.sum("o_chars").alias("chars"), F.max("o_chars").alias("most")).where("chars > 300 OR most > 80").select(*keys, "item_no")


def labels(texts: DataFrame, images: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Texts that are left: those that no image covers to 80 %."""
    return without(texts, images, overlap(Rect(), _other()) >= 0.8 * Rect().area, keys)


def erasures(images: DataFrame, texts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """By image the texts that touch it, in order: keys, item_no, erase."""
    pairs = meetings(images, texts, overlap(_other(), Rect()) > 0, keys, more=("item_no",))
    return pairs.groupBy(*keys, "item_no").agg(F.sort_array(F.collect_list("o_item_no")).alias("erase"))


def box_candidates(drawings: DataFrame, page_area: float) -> DataFrame:
    """Drawings large enough and filled or framed: shade (1 is white), framed."""
    r = Rect()
    return drawings.where((r.width >= 40) & (r.height >= 20) & (r.area <= 0.6 * page_area) & ((F.col("shade") <= 0.96) | F.col("framed")))


def outermost(rects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rectangles with no other around both corners."""
    r = Rect()
    differ = (_other().x0 != r.x0) | (_other().y0 != r.y0) | (_other().x1 != r.x1) | (_other().y1 != r.y1)
    return without(rects, rects, differ & holds(_other(), r.x0, r.y0) & holds(_other(), r.x1, r.y1), keys, grow=1.0)


def occupied(boxes: DataFrame, texts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Boxes that hold text, but aren't a frame around nine tenths of a page with more than three texts: n_inside."""
    total = texts.groupBy(*keys).agg(F.count("*").alias("total"))
    pairs = meetings(boxes, texts, belongs(_other(), Rect()), keys, grow=3.0)
    held = pairs.groupBy(*keys, "item_no").agg(F.count("*").alias("n_inside")).join(total, keys)
    return held.where(~((F.col("total") > 3) & (F.col("n_inside") >= 0.9 * F.col("total")))).select(*keys, "item_no", "n_inside")


def memberships(items: DataFrame, boxes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For each item in a box the first such box: item_no, box_no."""
    pairs = meetings(items, boxes, belongs(Rect(), _other()), keys, grow=3.0, more=("item_no",))
    return pairs.groupBy(*keys, "item_no").agg(F.min("o_item_no").alias("box_no"))


def merge_overlapping(rects: list[tuple], gap: float) -> list[tuple]:
    """Unions of rectangles that overlap when one is grown by a gap, until none do; top-left first.

    Each pass sweeps the rectangles by their left side and joins the classes of those that meet.
    """
    while True:
        rects = sorted(set(rects))
        root = list(range(len(rects)))

        def find(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        met = False
        for i, a in enumerate(rects):
            for j in range(i + 1, len(rects)):
                b = rects[j]
                if b[0] >= a[2] + gap:
                    break
                if min(a[2] + gap, b[2]) > max(a[0] - gap, b[0]) and min(a[3] + gap, b[3]) > max(a[1] - gap, b[1]):
                    root[find(j)] = find(i)
                    met = True
        if not met:
            return sorted(rects, key=lambda r: (r[1], r[0], r[3], r[2]))
        groups: dict[int, list] = {}
        for i, r in enumerate(rects):
            groups.setdefault(find(i), []).append(r)
        rects = [(min(r[0] for r in g), min(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g)) for g in groups.values()]


def merged(rects: DataFrame, gap: float = 2.0, keys: list[str] = KEYS) -> DataFrame:
    """Rectangles of a page merged until none overlap when one is grown by a gap, numbered from 1 from the top left.

    A round contracts: each rectangle goes with that of its neighbours and itself which a hash puts first, and what
    goes together becomes its union. All that a union holds ends in one rectangle anyway, whatever the order, so
    rounds reach the same fixpoint as merging pair by pair; hashes differ by round, so that chains shrink by a
    factor. Pages on which nothing met are done; the others go on. Rectangles with a side that is null stay alone.
    """
    r = Rect()
    meets = (r.x0 - gap < _other().x1) & (_other().x0 - gap < r.x1) & (r.y0 - gap < _other().y1) & (_other().y0 - gap < r.y1)
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in SIDES))
    now, grid = counted(rects.select(*keys, box.alias("r")).distinct().select(*keys, "r.*"), keys, gap)
    crowd, done, n = grid is not None, None, 0  # pages only get emptier
    while True:
        own = now.withColumn("p", F.struct(F.xxhash64(F.lit(n), *SIDES).alias("h"), *SIDES))
        pairs = meetings(own, own, meets, keys, gap, more=("p",), may_crowd=crowd)
        first = pairs.groupBy(*keys, "p").agg(F.min("o_p").alias("to"), (F.count("*") > 1).alias("met"))
        # one with an empty side meets others, not itself: its own place counts too
        told = own.join(first, [*keys, "p"], "left").select(*keys, F.coalesce(F.least("to", "p"), F.col("p")).alias("to"), F.coalesce("met", F.lit(False)).alias("met"), *SIDES)
        union = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), SIDES, strict=True)]
        round_ = saved(told.groupBy(*keys, "to").agg(*union, F.bool_or("met").alias("met")).drop("to"), "rects")
        going = round_.where("met").select(*keys).distinct()
        rest = round_.join(going, keys, "left_anti").select(*keys, *SIDES)
        done = rest if done is None else done.unionByName(rest)
        if going.isEmpty():
            break
        now, n = round_.join(going, keys, "left_semi").select(*keys, *SIDES).distinct(), n + 1
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "y1", "x1")
    return done.select(*keys, F.row_number().over(w).alias("rect_no"), *SIDES)


def numbered_files(rects: DataFrame, stem: str, ending: str = "webp", keys: list[str] = KEYS) -> DataFrame:
    """Image files by page in reading order: stem-pNNN-II.ending."""
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "x1", "y1")
    return rects.withColumn("file", F.format_string(f"{stem}-p%03d-%02d.{ending}", F.col(keys[1]) + 1, F.row_number().over(w)))
