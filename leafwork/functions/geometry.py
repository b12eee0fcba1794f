"""Rectangle expressions over columns x0, y0, x1, y1, taken with a prefix or from a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect:
    """Four columns: ``Rect("a_")`` is a_x0 ..., ``Rect(df["r"])`` the fields of a struct."""

    def __init__(self, of: str | Column = ""):
        pick = (lambda k: F.col(of + k)) if isinstance(of, str) else (lambda k: of[k])
        self.x0, self.y0, self.x1, self.y1 = map(pick, ("x0", "y0", "x1", "y1"))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2


def overlap(a: Rect, b: Rect) -> Column:
    """Area that two rectangles share."""
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def holds(r: Rect, x: Column, y: Column, slack: float = 1.0) -> Column:
    """Whether a point lies in a rectangle, with some slack."""
    return x.between(r.x0 - slack, r.x1 + slack) & y.between(r.y0 - slack, r.y1 + slack)


def belongs(item: Rect, box: Rect, slack: float = 3.0) -> Column:
    """Whether an item is part of a box: its centre lies inside, or most of it is covered."""
    return holds(box, item.cx, item.cy, slack) | (overlap(item, box) >= 0.6 * F.greatest(item.area, F.lit(1.0)))


def in_margin(r: Rect, page: Rect | tuple[float, float, float, float]) -> Column:
    """Whether a rectangle lies wholly in the upper or lower 12 % or the outer 10 % of a page."""
    px0, py0, px1, py1 = (page.x0, page.y0, page.x1, page.y1) if isinstance(page, Rect) else map(F.lit, page)
    h, w = py1 - py0, px1 - px0
    return (r.y1 < py0 + 0.12 * h) | (r.y0 > py1 - 0.12 * h) | (r.x1 < px0 + 0.10 * w) | (r.x0 > px1 - 0.10 * w)


def bounds() -> list[Column]:
    """Aggregates for the union of a group's rectangles."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
