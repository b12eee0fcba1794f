"""Tables without rules: words set in columns, found by what stands at one height and in line."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np

from leafwork.operators.paragraphs import NAME, NUMBER, SOFT_HYPHEN, header_pairs, stat_table

Rect = tuple[float, float, float, float]
#: Distance of left sides that stand in one column.
ALIGNED = 8.0
MOST_CELLS, LONGEST, SHORTEST = 14, 160, 30
#: Heights between rows of a table, and between a row and what goes on below it.
ROW_GAP, NEXT_LINE, BELOW_LAST = 1.6, 1.2, 1.4
BOLD = re.compile("bold|black|heavy", re.I)
NUMERIC = re.compile(r"[+−–-]?\d+([-–]\d+)?")


class Cell(NamedTuple):
    """A piece of text, where it stands, and the lines (block, line) that it comes from."""

    box: Rect
    text: str
    bold: bool
    lines: frozenset = frozenset()

    @property
    def middle(self) -> float:
        return (self.box[1] + self.box[3]) / 2

    @property
    def height(self) -> float:
        return max(1.0, self.box[3] - self.box[1])


@dataclass(frozen=True)
class Row:
    cells: list[Cell]

    @cached_property
    def box(self) -> Rect:
        return hull([c.box for c in self.cells])

    @property
    def height(self) -> float:
        return max(1.0, self.box[3] - self.box[1])

    @property
    def lines(self) -> frozenset:
        return frozenset().union(*(c.lines for c in self.cells))


def hull(boxes: list[Rect]) -> Rect:
    if len(boxes) == 1:
        return tuple(map(float, boxes[0]))
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return (float(min(x0)), float(min(y0)), float(max(x1)), float(max(y1)))


def runs_of(items: list, gap, left=lambda i: i.box[0], right=lambda i: i.box[2]) -> list[list]:
    """Items in order, parted where one lies ``gap(item)`` or more to the right of all before it in its run."""
    out: list[list] = []
    reach = 0.0
    for i in items:
        if out and left(i) - reach < gap(i):
            out[-1].append(i)
            reach = max(reach, right(i))
        else:
            out.append([i])
            reach = right(i)
    return out


def line_cells(ln: dict, body: float, where: tuple[int, int]) -> list[Cell]:
    """Cells of a line: a gap of a whole size parts them."""
    spans = [(t, s) for s in ln["spans"] if (t := s["text"].replace(SOFT_HYPHEN, "")).strip()]
    out, lines = [], frozenset([where])
    for run in runs_of(spans, lambda s: s[1]["size"] or body, lambda s: s[1]["x0"], lambda s: s[1]["x1"]):
        text, reach = run[0][0], run[0][1]["x1"]
        for t, s in run[1:]:
            text += t if s["x0"] - reach < 0.15 * (s["size"] or body) else f" {t}"
            reach = max(reach, s["x1"])
        bold = all(s["flags"] & 16 or s["font"] and BOLD.search(s["font"]) for _, s in run)
        out.append(Cell(hull([(s["x0"], s["y0"], s["x1"], s["y1"]) for _, s in run]), " ".join(text.split()), bool(bold), lines))
    return out


def united(cells: list[Cell]) -> Cell:
    """Cells made one: as high as the first."""
    first = cells[0]
    box = (first.box[0], first.box[1], max(c.box[2] for c in cells), first.box[3])
    return Cell(box, " ".join(c.text for c in cells), all(c.bold for c in cells), frozenset().union(*(c.lines for c in cells))) if len(cells) > 1 else first


def text_rows(blocks: list[list[dict]], body: float, width: float) -> list[Row]:
    """Rows of cells at one height within each block; lone narrow cells of neighbouring blocks are joined."""
    many, lone = [], []
    for b, lines in enumerate(blocks):
        cells = sorted((c for k, ln in enumerate(lines) for c in line_cells(ln, body, (b, k))), key=lambda c: (c.middle, c.box[0]))
        middles, at = [c.middle for c in cells], 0
        while at < len(cells):
            # all that is at the height of the row's first cell; cells are sorted by height
            end = bisect_right(middles, middles[at] + 0.4 * cells[at].height, at)
            own = sorted(cells[at:end], key=lambda c: c.box[0])
            row = Row([united(run) for run in runs_of(own, lambda c: 0.6 * body)])
            (many if len(row.cells) > 1 else lone).append(row)
            at = end
    return many + side_by_side(lone, body, width)


def side_by_side(rows: list[Row], body: float, width: float) -> list[Row]:
    """Rows of one narrow cell at one height, each right of the one before, joined from the left."""
    narrow = lambda r: r.box[2] - r.box[0] < 0.3 * width
    centre = lambda r: (r.box[1] + r.box[3]) / 2
    rows = sorted(rows, key=lambda r: (r.box[1], r.box[0]))
    level = sorted((centre(r), k) for k, r in enumerate(rows) if narrow(r))
    taken = [False] * len(rows)
    out = []
    for k, first in enumerate(rows):
        if taken[k]:
            continue
        chain = [first]
        if narrow(first):
            y, most = centre(first), 0.4 * first.height
            # a little more than the level, then exactly the level
            near = level[bisect_left(level, (y - 1.01 * most,)) : bisect_left(level, (y + 1.01 * most, len(rows)))]
            for j in sorted(j for c, j in near if j > k and not taken[j] and abs(c - y) <= most):
                if 0 <= rows[j].box[0] - chain[-1].box[2] <= 4 * body:
                    chain.append(rows[j])
                    taken[j] = True
        out.append(Row([c for r in chain for c in r.cells]))
    return out


def anchors_of(rows: list[Row]) -> np.ndarray:
    """Means of left sides that follow one another closely."""
    x = np.sort([c.box[0] for r in rows for c in r.cells])
    return np.array([part.mean() for part in np.split(x, np.flatnonzero(np.diff(x) > ALIGNED) + 1)])


class Columns:
    """The columns of a group of rows as it grows: left sides that follow one another closely, and how far the group reaches."""

    def __init__(self, row: Row):
        self.low, self.high, self.sum, self.n = [], [], [], []
        self.left, self.right = row.box[0], row.box[2]
        self.add(row)

    def add(self, row: Row) -> None:
        self.left, self.right = min(self.left, row.box[0]), max(self.right, row.box[2])
        for c in row.cells:
            x = c.box[0]
            k = bisect_right(self.low, x)
            if k and x - self.high[k - 1] <= ALIGNED:
                k -= 1
                self.high[k], self.sum[k], self.n[k] = max(self.high[k], x), self.sum[k] + x, self.n[k] + 1
            else:
                for part, v in ((self.low, x), (self.high, x), (self.sum, x), (self.n, 1)):
                    part.insert(k, v)
            if k + 1 < len(self.low) and self.low[k + 1] - self.high[k] <= ALIGNED:
                self.high[k], self.sum[k], self.n[k] = self.high[k + 1], self.sum[k] + self.sum[k + 1], self.n[k] + self.n[k + 1]
                for part in (self.low, self.high, self.sum, self.n):
                    del part[k + 1]

    def holds(self, x: float) -> bool:
        """Whether a left side stands on a column: if so, on the last that begins before it or on the next."""
        k = bisect_right(self.low, x)
        return any(abs(x - self.sum[j] / self.n[j]) <= ALIGNED for j in (k - 1, k) if 0 <= j < len(self.low))

    def in_line(self, row: Row) -> bool:
        """Whether two of a row's cells stand on columns of the group, and the row lies over it."""
        on = sum(self.holds(c.box[0]) for c in row.cells)
        return on >= min(2, len(row.cells)) and min(row.box[2], self.right) > max(row.box[0], self.left)


def row_groups(rows: list[Row]) -> list[list[Row]]:
    """Rows in line that follow one another; rows beside a group are left for the next."""
    rows = sorted(rows, key=lambda r: (r.box[1], r.box[0]))
    after, out, first = list(range(1, len(rows) + 1)), [], 0  # by row the next that is left
    while first < len(rows):
        group, columns = [rows[first]], Columns(rows[first])
        head = before = None
        k = after[first]
        while k < len(rows):
            row, last = rows[k], group[-1]
            gap = row.box[1] - last.box[3]
            if gap > ROW_GAP * max(last.height, row.height):  # all further rows are lower still
                break
            if gap >= -0.3 * last.height and columns.in_line(row):
                group.append(row)
                columns.add(row)
            else:
                if before is None:
                    head = k
                else:
                    after[before] = k
                before = k
            k = after[k]
        if before is None:
            head = k
        else:
            after[before] = k
        out.append(group)
        first = head
    return out


def gone_on(group: list[Row], others: list[Row], anchors: np.ndarray) -> tuple[list[Row], frozenset]:
    """The rows with lines of one cell added to the cells they go on below, and the lines used."""
    cells = [list(r.cells) for r in group]
    # A line belongs to the first row below which it starts within a line's height, and above the next row.
    ends = [min(group[k + 1].box[1] if k + 1 < len(group) else r.box[3] + BELOW_LAST * r.height, r.box[3] + NEXT_LINE * r.height) for k, r in enumerate(group)]
    tops = [r.box[1] for r in group]
    used: set = set()
    for other in sorted((o for o in others if len(o.cells) == 1), key=lambda o: o.box[1]):
        (extra,) = other.cells
        # rows are in order from the top: one it goes on below begins above it, and the next one doesn't
        near_rows = range(max(0, bisect_right(tops, extra.box[1]) - 1), bisect_right(tops, extra.box[1] + 1))
        k = next((k for k in near_rows if group[k].box[3] - 1 <= extra.box[1] < ends[k]), None)
        near = np.flatnonzero(np.abs(anchors - extra.box[0]) <= ALIGNED)
        if k is None or not len(near) or near[0] == 0:
            continue
        away = [abs(c.box[0] - anchors[near[0]]) for c in cells[k]]
        best = int(np.argmin(away))
        if away[best] <= ALIGNED:
            c = cells[k][best]
            cells[k][best] = c._replace(text=f"{c.text} {extra.text}", box=(*c.box[:3], max(c.box[3], extra.box[3])))
            used |= other.lines
    return [Row(c) for c in cells], frozenset(used)


def table_of(group: list[Row], others: list[Row]) -> tuple[dict, frozenset] | None:
    """The table of rows in line, and the further lines it uses; one row alone must be a stat line."""
    if len(group) == 1:
        table = stat_table(" ".join(c.text for c in group[0].cells))
        return (table, frozenset()) if table else None
    anchors = anchors_of(group)
    rows, used = gone_on(group, others, anchors)
    grid = np.full((len(rows), len(anchors)), "", object)
    for k, row in enumerate(rows):
        for c, column in zip(row.cells, np.abs(np.array([c.box[0] for c in row.cells])[:, None] - anchors).argmin(1), strict=True):
            grid[k, column] = f"{grid[k, column]} {c.text}".strip()
    solid = [[c for c in r if c] for r in grid.tolist()]
    if all(len(r) >= 4 and len(r) % 2 == 0 and all(map(NAME.fullmatch, r[::2])) and all(map(NUMBER.fullmatch, r[1::2])) for r in solid):
        return header_pairs([list(zip(r[::2], r[1::2], strict=True)) for r in solid], max(map(len, solid)) // 2), used
    grid = grid[:, (grid != "").any(0)]
    if grid.shape[1] < 2:
        return None
    bold = [all(c.bold for c in r.cells) for r in group]
    counted = any(t[:1] in "0123456789+−–-" for t in grid[1:, 0] if t) and not NUMERIC.fullmatch(grid[0, 0])
    return {"k": "table", "rows": grid.tolist(), "th": [0] if bold[0] and not all(bold[1:]) or counted else []}, used


def text_tables(blocks: list[list[dict]], body: float, width: float) -> tuple[list[tuple[Rect, dict]], set]:
    """Gridless tables (bounds, table) and the (block, line) pairs that they use up."""

    def may_be(row: Row) -> bool:
        sizes = [len(c.text) for c in row.cells]
        return 2 <= len(sizes) <= MOST_CELLS and max(sizes) <= LONGEST and min(sizes) <= SHORTEST

    rows = text_rows(blocks, body, width)
    others, found, used = sorted((r for r in rows if not may_be(r)), key=lambda r: r.box[1]), [], set()
    tops = [r.box[1] for r in others]
    for group in row_groups([r for r in rows if may_be(r)]):
        # what may go on below its rows
        top, bottom = min(r.box[3] for r in group) - 1, max(r.box[3] + BELOW_LAST * r.height for r in group)
        if made := table_of(group, others[bisect_left(tops, top) : bisect_right(tops, bottom)]):
            found.append((hull([r.box for r in group]), made[0]))
            used |= made[1].union(*(r.lines for r in group))
    return found, used
