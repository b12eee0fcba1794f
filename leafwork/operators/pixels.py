"""Pictures given as rows of pixels: flatness, visible parts, names of resources. No picture is decoded here.

A picture's pixels are rows (keys, row_no, values), so that a large one is spread over tasks and its
statistics combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels for a point of the page, at the resolution of visibility tests.
ZOOM = 48 / 72
#: Largest standard deviation of a flat picture, and smallest difference of a changed pixel.
FLAT, CHANGED = 8.0, 10


def flat(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """By picture (rows of grey values: keys, row_no, values) whether it is almost of one colour: keys, flat.

    A picture of fewer than two rows or columns is flat; one without pixels has no row.
    """
    total = lambda f: F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + f(v.cast("long")))
    rows = pixels.select(*keys, "row_no", F.size("values").alias("width"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("height"), F.max("width").alias("width"), F.sum("width").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    # The variance in whole numbers: n * q - s * s is exact.
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double") / F.col("n") / F.col("n")
    return sums.select(*keys, F.coalesce((F.col("height") < 2) | (F.col("width") < 2) | (spread < FLAT * FLAT), F.lit(True)).alias("flat"))


def framed(images: DataFrame, page: tuple[float, float, float, float], keys: list[str], item: str = "item_no") -> DataFrame:
    """Images with the pixels that they may cover, px0 to py1, ends not included; none without."""
    low = lambda c, o: F.greatest(F.lit(0), ((F.col(c) - o) * ZOOM).cast("int"))
    high = lambda c, o: F.ceil((F.col(c) - o) * ZOOM).cast("int")
    ox, oy = page[0], page[1]
    own = images.select(*keys, item, "x0", "y0", "x1", "y1", low("x0", ox).alias("px0"), low("y0", oy).alias("py0"), high("x1", ox).alias("px1"), high("y1", oy).alias("py1"))
    return own.where((F.col("px1") > F.col("px0")) & (F.col("py1") > F.col("py0")))


def reached(images: DataFrame, page: tuple[float, float, float, float], height: int, keys: list[str]) -> DataFrame:
    """The rows of pixels of a page (keys, row_no), of so many, between the first and the last that its images reach; others are in no image."""
    own = framed(images, page, keys, keys[0]).where(F.col("py0") < height).groupBy(*keys).agg(F.min("py0").alias("a"), F.least(F.max("py1"), F.lit(height)).alias("z"))
    return own.select(*keys, F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("row_no"))


def visible(images: DataFrame, differences: DataFrame, page: tuple[float, float, float, float], keys: list[str], item: str = "item_no") -> DataFrame:
    """Images (keys, item, x0 to y1) cut to the pixels that change when they are left out; those without any have no row.

    differences: for each page's keys its rows of pixels (row_no, values: how much a pixel changes), at ZOOM. Only the places
    of changed pixels are dealt to the images, from rows that have any.
    """
    ox, oy = page[0], page[1]
    places = F.filter(F.transform("values", lambda v, i: F.when(v > CHANGED, i)), lambda i: i.isNotNull())
    spots = differences.where(F.exists("values", lambda v: v > CHANGED)).select(*keys, "row_no", places.alias("places"))
    pairs = framed(images, page, keys, item).join(spots, keys).where((F.col("row_no") >= F.col("py0")) & (F.col("row_no") < F.col("py1")))
    inside = F.filter("places", lambda i: (i >= F.col("px0")) & (i < F.col("px1")))
    found = pairs.select(*keys, item, "x0", "y0", "x1", "y1", "row_no", inside.alias("in")).select("*", F.array_min("in").alias("a"), (F.array_max("in") + 1).alias("z")).where("a is not null")
    boxes = found.groupBy(*keys, item, "x0", "y0", "x1", "y1").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("row_no").alias("b"), (F.max("row_no") + 1).alias("e"))
    back = lambda c, o: F.col(c) / ZOOM + o
    sides: dict[str, Column] = {"x0": F.greatest("x0", back("a", ox) - 1), "y0": F.greatest("y0", back("b", oy) - 1), "x1": F.least("x1", back("z", ox) + 1), "y1": F.least("y1", back("e", oy) + 1)}
    return boxes.select(*keys, item, *(c.alias(k) for k, c in sides.items()))


def named(images: DataFrame, resources: DataFrame, keys: list[str]) -> DataFrame:
    """Images with the name of their resource: of resources (keys, ord, xref, name) the first with the image's xref; null without one."""
    first = resources.groupBy(*keys, "xref").agg(F.min(F.struct("ord", "name"))["name"].alias("name"))
    return images.join(first, [*keys, "xref"], "left")
