"""Joins of rectangles by grids against all pairs."""

import random

import pytest

from leafwork.functions.geometry import Rect, overlap
from leafwork.operators import geometry, spatial
from pyspark.sql import functions as F

KEYS = ["book_id", "page_no"]
KIND = "book_id long, page_no int, item_no int, x0 double, y0 double, x1 double, y1 double, chars int"


def drawn(spark, seed, page, n, side, far=600):
    r = random.Random(seed)
    rows = [(1, page, i, x := r.uniform(0, far), y := r.uniform(0, far), x + r.uniform(0, side), y + r.uniform(0, side), 1) for i in range(n)]
    return [*rows, (1, page, n, 0.0, 0.0, 600.0, 700.0, 1), (1, page, n + 1, None, 0.0, 1.0, 1.0, 1), (1, page, n + 2, float("nan"), 0.0, 1.0, 1.0, 1)]


def area(a, b):
    return max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * max(0.0, min(a[6], b[6]) - max(a[4], b[4]))


def good(rows):
    return [r for r in rows if r[3] is not None and r[3] == r[3]]


@pytest.mark.parametrize("crowded", [0, 64, 10**9])
def test_joins_against_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    items, others = drawn(spark, 1, 0, 150, 40) + drawn(spark, 2, 1, 9, 200), drawn(spark, 3, 0, 120, 60, 300) + drawn(spark, 4, 1, 5, 300) + drawn(spark, 5, 2, 70, 9)
    a, b = spark.createDataFrame(items, KIND), spark.createDataFrame(others, KIND)
    got = spatial.meetings(a, b, overlap(Rect(), Rect("o_")) > 0, KEYS, more=("item_no",)).select("page_no", "item_no", "o_item_no").collect()
    want = sorted((x[1], x[2], y[2]) for x in good(items) for y in good(others) if x[1] == y[1] and area(x, y) > 0)
    assert sorted(map(tuple, got)) == want
    left = spatial.without(a, b, overlap(Rect(), Rect("o_")) > 0, KEYS).select("page_no", "item_no").collect()
    assert sorted(map(tuple, left)) == sorted({(x[1], x[2]) for x in items} - {(p, i) for p, i, _ in want})

    def inside(i, box):
        cx, cy = (i[3] + i[5]) / 2, (i[4] + i[6]) / 2
        size = (i[5] - i[3]) * (i[6] - i[4])
        return box[3] - 3 <= cx <= box[5] + 3 and box[4] - 3 <= cy <= box[6] + 3 or area(i, box) >= 0.6 * max(1.0, size)

    first = {}
    for x in good(items):
        for y in good(others):
            if x[1] == y[1] and inside(x, y):
                first[x[1], x[2]] = min(y[2], first.get((x[1], x[2]), 10**9))
    assert {(r["page_no"], r["item_no"]): r["box_no"] for r in geometry.memberships(a, b).collect()} == first
    rects = good(others)
    around = {(x[1], x[2]) for x in rects for y in rects if x[1] == y[1] and x[3:7] != y[3:7] and y[3] - 1 <= x[3] <= y[5] + 1 and y[4] - 1 <= x[4] <= y[6] + 1 and y[3] - 1 <= x[5] <= y[5] + 1 and y[4] - 1 <= x[6] <= y[6] + 1}
    assert {(r["page_no"], r["item_no"]) for r in geometry.outermost(b).collect()} == {(x[1], x[2]) for x in others} - around
    none = b.where("false")
    assert geometry.outside(a, none).count() == len(items) and geometry.memberships(none, b).count() == 0 and geometry.merged(none).count() == 0


@pytest.mark.parametrize("crowded", [0, 64])
def test_merging_by_rounds_against_the_sweep(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    r, rows, want = random.Random(6), [], {}
    for page in range(12):
        n, side = r.choice([(1, 50), (8, 30), (60, 12), (200, 5)])
        rects = [(float(x := r.randrange(0, 300)), float(y := r.randrange(0, 300)), float(x + r.randrange(1, side)), float(y + r.randrange(1, side))) for _ in range(n)]
        if page == 3:  # a chain whose links meet in a row only
            rects = [(10.0 * k, 0.0, 10.0 * k + 9.0, 5.0) for k in range(100)]
        rows += [(1, page, i, *x, 1) for i, x in enumerate(rects + rects[:2])]
        want[page] = geometry.merge_overlapping(rects, 2.0)
    got = {}
    for x in geometry.merged(spark.createDataFrame(rows, KIND)).orderBy("page_no", "rect_no").collect():
        got.setdefault(x["page_no"], []).append((x["x0"], x["y0"], x["x1"], x["y1"]))
    assert got == want and got[3] == [(0.0, 0.0, 999.0, 5.0)]


def test_crowded_pages_have_few_candidates(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("book_id"), F.lit(0).alias("page_no"), F.col("id").cast("int").alias("item_no"), (F.rand(1) * 600).alias("x0"), (F.rand(2) * 700).alias("y0"))
    rows = rows.withColumns({"x1": F.col("x0") + 4.0, "y1": F.col("y0") + 6.0})
    grid = spatial.grids(rows, KEYS)
    cells = spatial.dealt(rows, grid, KEYS).groupBy("cx", "cy").count()
    tried = cells.agg(F.sum(F.col("count") * F.col("count")).alias("n"), F.max("count").alias("most")).collect()[0]
    assert tried["n"] < 40 * n and tried["most"] < 60
    assert geometry.merged(rows.where("item_no < 3000"), 0.0).count() > 100
