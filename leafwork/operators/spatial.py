"""Joins of rectangles on pages, crowded ones too: these are dealt to the cells of a grid, a grid for each page.

On a page with few others all pairs are tried, in one join on the page. A crowded page gets cells by its own
rectangles: about PER_CELL of them to a cell, but no cell is smaller than the mean rectangle, so one is in few cells
on average. Pairs meet in cells, and each is reported once, by the cell in which both begin; so a page of many
drawings is spread over as many join keys as it has cells. Which pages are crowded is counted first, and kept as a
table: Spark then knows its size and broadcasts it where it is small.

Rectangles with a side that is null or not finite meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.storage import saved

SIDES = ("x0", "y0", "x1", "y1")
PER_CELL = 4
#: Others on a page from which it is crowded. Both ways find the same pairs.
CROWDED = 64
#: Prefix of the other rectangle's columns in a pair.
OTHER = "o_"


def _known(prefix: str = "") -> Column:
    total = sum((F.col(prefix + c) for c in SIDES[1:]), F.col(prefix + SIDES[0]))
    return F.coalesce(~F.isnan(total) & (F.abs(total) != float("inf")), F.lit(False))


def grids(rects: DataFrame, keys: list[str], grow: float = 0.0) -> DataFrame:
    """By crowded page where its grid begins, how wide and high cells are, and the last cell: keys, gx, gy, gw, gh, nx, ny."""
    own = rects.where(_known()).groupBy(*keys).agg(
        (F.min("x0") - grow).alias("gx"), (F.min("y0") - grow).alias("gy"), (F.max("x1") + grow).alias("_x1"), (F.max("y1") + grow).alias("_y1"),
        F.sqrt(F.count("*") / PER_CELL).alias("_k"), (F.avg(F.col("x1") - F.col("x0")) + 2 * grow).alias("_w"), (F.avg(F.col("y1") - F.col("y0")) + 2 * grow).alias("_h"), F.count("*").alias("_n"),
    ).where(F.col("_n") > CROWDED)
    side = lambda lo, hi, mean: F.greatest((F.col(hi) - F.col(lo)) / F.greatest("_k", F.lit(1.0)), F.col(mean), F.lit(1.0))
    own = own.withColumns({"gw": side("gx", "_x1", "_w"), "gh": side("gy", "_y1", "_h")})
    last = lambda lo, hi, size: F.floor((F.col(hi) - F.col(lo)) / F.col(size))
    return own.select(*keys, "gx", "gy", "gw", "gh", last("gx", "_x1", "gw").alias("nx"), last("gy", "_y1", "gh").alias("ny"))


def dealt(rects: DataFrame, grid: DataFrame, keys: list[str], grow: float = 0.0, prefix: str = "") -> DataFrame:
    """The rectangles that reach into the grid, once for each of their cells (cx, cy), with their first cell (fx, fy, prefixed)."""
    x0, y0, x1, y1 = (F.col(prefix + c) for c in SIDES)
    cell = lambda v, lo, size, last: F.greatest(F.lit(0).cast("long"), F.least(F.floor((v - F.col(lo)) / F.col(size)), F.col(last)))
    end = lambda lo, size, last: F.col(lo) + F.col(size) * (F.col(last) + 1)
    own = rects.where(_known(prefix)).join(grid, keys)
    own = own.where((x1 + grow >= F.col("gx")) & (x0 - grow <= end("gx", "gw", "nx")) & (y1 + grow >= F.col("gy")) & (y0 - grow <= end("gy", "gh", "ny")))
    fx, fy = cell(x0 - grow, "gx", "gw", "nx"), cell(y0 - grow, "gy", "gh", "ny")
    lx, ly = F.greatest(fx, cell(x1 + grow, "gx", "gw", "nx")), F.greatest(fy, cell(y1 + grow, "gy", "gh", "ny"))
    own = own.select(*rects.columns, fx.alias(f"{prefix}fx"), fy.alias(f"{prefix}fy"), F.explode(F.sequence(fx, lx)).alias("cx"), fy.alias("_a"), ly.alias("_z"))
    return own.withColumn("cy", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")


def prefixed(df: DataFrame, prefix: str, *more: str, keys: list[str]) -> DataFrame:
    """Keys, and sides and other columns with a prefix."""
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in (*SIDES, *more)))


def counted(others: DataFrame, keys: list[str], grow: float = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """The others as a table that is made once, and the grids of crowded pages, if any page is."""
    own = saved(others, "others")
    found = saved(grids(own, keys, grow), "grids")
    return own, None if found.isEmpty() else found


def _few(items: DataFrame, others: DataFrame, condition: Column, keys: list[str], how: str, more: tuple[str, ...] = ()) -> DataFrame:
    right = prefixed(others.where(_known()), OTHER, *more, keys=keys)
    if how == "inner":
        return items.join(right, keys).where(condition & _known())
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = condition & _known()
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return items.join(right, same, how)


def _many(items: DataFrame, others: DataFrame, condition: Column, keys: list[str], grid: DataFrame, grow: float, more: tuple[str, ...] = ()) -> DataFrame:
    right = dealt(prefixed(others, OTHER, *more, keys=keys), grid, keys, grow, OTHER)
    once = (F.col("cx") == F.greatest("fx", OTHER + "fx")) & (F.col("cy") == F.greatest("fy", OTHER + "fy"))
    return dealt(items, grid, keys).join(right, [*keys, "cx", "cy"]).where(once & condition).drop("cx", "cy", "fx", "fy", OTHER + "fx", OTHER + "fy")


def meetings(items: DataFrame, others: DataFrame, condition: Column, keys: list[str], grow: float = 0.0, more: tuple[str, ...] = (), may_crowd: bool = True) -> DataFrame:
    """Pairs of a page for which the condition holds, of items and others (their columns prefixed); it may hold only where an item and an other grown by ``grow`` touch."""
    own, grid = counted(others, keys, grow) if may_crowd else (others, None)
    if grid is None:
        return _few(items, own, condition, keys, "inner", more)
    return _few(items, own.join(grid, keys, "left_anti"), condition, keys, "inner", more).unionByName(_many(items, own, condition, keys, grid, grow, more))


def without(items: DataFrame, others: DataFrame, condition: Column, keys: list[str], grow: float = 0.0, item: str = "item_no") -> DataFrame:
    """Items for which the condition holds with no other."""
    own, grid = counted(others, keys, grow)
    items = own if items is others else items
    if grid is None:
        return _few(items, own, condition, keys, "left_anti")
    crowded = items.join(grid, keys, "left_semi")
    met = _many(crowded, own, condition, keys, grid, grow).select(*keys, item)
    return _few(items.join(grid, keys, "left_anti"), own, condition, keys, "left_anti").unionByName(crowded.join(met, [*keys, item], "left_anti"))
