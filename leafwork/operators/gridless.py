"""Tables without rules on many pages at once: the rules of ``grids`` over arrays of spans.

Cells, rows and groups of rows are runs in sorted arrays. A group whose rows follow one another in line, in columns no wider
than ``ALIGNED``, is told at once from all its rows; only groups that skip rows, hold stat lines or go on below, and pages
whose blocks stand side by side, are worked on one at a time by the functions of ``grids``.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafwork.functions.stats import ABBR, ABBREVIATIONS
from leafwork.functions.text import BLANKS
from leafwork.operators.grids import ALIGNED, BELOW_LAST, LONGEST, MOST_CELLS, NUMERIC, ROW_GAP, SHORTEST, Cell, Rect, Row, row_groups, table_of, text_tables
from leafwork.operators.paragraphs import SOFT_HYPHEN
from leafwork.operators.segments import heads, running_max

#: What str.split takes for blanks.
_BLANK = f"[{BLANKS}\x1c-\x1f]"
_NAMES = pa.array(ABBREVIATIONS)
#: Distances this near a bound are left to the exact functions.
_SLACK = 1e-6
#: Lines at a row's height that are looked at in one go.
_MOST_BELOW = 16


@dataclass
class Spans:
    """Spans in order; page, block and line are numbers that never fall, a line's number is its own over all pages. A size of 0 is the body's."""

    page: np.ndarray
    block: np.ndarray
    line: np.ndarray
    text: pa.Array
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    size: np.ndarray
    bold: np.ndarray

    def take(self, at: np.ndarray) -> Spans:
        return Spans(*(v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at] for v in (getattr(self, f.name) for f in fields(self))))


def _follows(group: np.ndarray) -> np.ndarray:
    """Whether each row is of the group of the one before it."""
    return np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)


def _before(x: np.ndarray) -> np.ndarray:
    return np.append(x[:1], x[:-1])


def _ranks(page: np.ndarray, y: np.ndarray, at_page: np.ndarray, at: np.ndarray, right: bool) -> np.ndarray:
    """For places on pages how many of the sorted (page, y) come before, with ``right`` also those at the place."""
    own = np.repeat([True, False], [len(y), len(at)])
    order = np.lexsort((own != right, np.concatenate([y, at]), np.concatenate([page, at_page])))
    out = np.empty(len(own), np.int64)
    out[order] = np.cumsum(own[order])
    return out[len(y) :]


def _joined(texts: pa.Array, start: np.ndarray, join) -> pa.Array:
    """The texts at the starts of runs, and for runs of more than one what ``join`` makes of (from, to)."""
    n = np.diff(start, append=len(texts))
    if (n == 1).all():
        return texts
    many = n > 1
    made = [join(a, a + k) for a, k in zip(start[many].tolist(), n[many].tolist(), strict=True)]
    return pc.replace_with_mask(texts.take(pa.array(start)), pa.array(many), pa.array(made, texts.type))


def _cells(s: Spans, raw: pa.Array, body: float) -> Spans:
    """Cells of lines; a gap of a whole size parts them. ``raw`` are the texts with their blanks."""
    reach, size = _before(running_max(s.line, s.x1)), np.where(s.size == 0, body, s.size)
    gap = s.x0 - reach
    start = np.flatnonzero(~_follows(s.line) | ~(gap < size))
    if len(start) == len(s.line):
        return s
    close = gap < 0.15 * size

    def join(a: int, z: int) -> str:
        parts = raw.slice(a, z - a).to_pylist()
        return " ".join("".join([parts[0], *(t if near else f" {t}" for t, near in zip(parts[1:], close[a + 1 : z], strict=True))]).split())

    low, high, every = np.minimum.reduceat, np.maximum.reduceat, np.logical_and.reduceat
    return Spans(s.page[start], s.block[start], s.line[start], _joined(s.text, start, join), low(s.x0, start), low(s.y0, start), high(s.x1, start), high(s.y1, start), size[start], every(s.bold, start))


def _rows(c: Spans) -> tuple[Spans, np.ndarray]:
    """Cells sorted by row and from the left, and the number of the row of each: what is at the height of its first."""
    middle, height = (c.y0 + c.y1) / 2, np.maximum(1.0, c.y1 - c.y0)
    order = np.lexsort((c.x0, middle, c.block))
    c, middle, height = c.take(order), middle[order], height[order]
    begins = ~_follows(c.block) | (middle != _before(middle))
    level = np.flatnonzero(begins)
    mixed = np.append(_follows(c.block[level])[1:] & (middle[level][1:] <= (middle + 0.4 * height)[level][:-1]), False)
    for b in np.unique(c.block[level[mixed]]):
        a, z = np.searchsorted(c.block, [b, b + 1]).tolist()
        begins[a:z] = False
        places, reach, at = middle[a:z].tolist(), (middle + 0.4 * height)[a:z].tolist(), 0
        while at < z - a:
            begins[a + at] = True
            at = bisect_right(places, reach[at], at)
    row = np.cumsum(begins) - 1
    return c.take(np.lexsort((c.x0, row))) if mixed.any() else c, row


def _united(c: Spans, row: np.ndarray, body: float) -> tuple[Spans, np.ndarray]:
    """Cells of rows that nearly touch made one, as high as the first, and their rows."""
    start = np.flatnonzero(~_follows(row) | ~(c.x0 - _before(running_max(row, c.x1)) < 0.6 * body))
    if len(start) == len(row):
        return c, row
    text = _joined(c.text, start, lambda a, z: " ".join(c.text.slice(a, z - a).to_pylist()))
    return Spans(c.page[start], c.block[start], c.line[start], text, c.x0[start], c.y0[start], np.maximum.reduceat(c.x1, start), c.y1[start], c.size[start], np.logical_and.reduceat(c.bold, start)), row[start]


def _one_page(s: Spans, body: float, width: float) -> tuple[list[tuple[Rect, dict]], list[int]]:
    """The tables of one page by the functions of ``grids``, and the lines that they use up."""
    blocks, numbers = [], []
    cut = heads(s.line).tolist()
    for a, z in zip(cut, [*cut[1:], len(s.line)], strict=True):
        if a == 0 or s.block[a] != s.block[a - 1]:
            blocks.append([])
            numbers.append([])
        own = zip(s.text.slice(a, z - a).to_pylist(), *(v[a:z].tolist() for v in (s.size, s.bold, s.x0, s.y0, s.x1, s.y1)), strict=True)
        blocks[-1].append({"spans": [{"text": t, "font": "", "size": size, "flags": 16 * bold, "x0": x0, "y0": y0, "x1": x1, "y1": y1} for t, size, bold, x0, y0, x1, y1 in own]})
        numbers[-1].append(int(s.line[a]))
    found, used = text_tables(blocks, body, width)
    return found, [numbers[b][k] for b, k in used]


def page_tables(spans: Spans, body: float, width: float) -> tuple[list[tuple[int, Rect, dict]], np.ndarray]:
    """``text_tables`` of many pages: (page, bounds, table) in order, and the numbers of the lines that they use up."""
    if not len(spans.page):
        return [], np.zeros(0, np.int64)
    raw = pc.replace_substring(spans.text, SOFT_HYPHEN, "")
    blank = pc.match_substring_regex(raw, _BLANK)
    clean = pc.replace_with_mask(raw, blank, pa.array([" ".join(t.split()) for t in raw.filter(blank).to_pylist()], raw.type))
    odd = np.zeros(spans.page[-1] + 1, bool)  # pages that are worked on one at a time
    sides = spans.x0 + spans.y0 + spans.x1 + spans.y1 + spans.size
    odd[spans.page[~np.isfinite(sides) | ~(spans.x1 >= spans.x0) | ~(spans.size >= 0) | (not body >= 0)]] = True
    own = np.flatnonzero((pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0) & ~odd[spans.page])
    s = Spans(**{**vars(spans), "text": clean}).take(own)
    found, used = _many_pages(s, raw.take(pa.array(own)), body, width, odd) if len(own) else ([], [])
    for p in np.flatnonzero(odd).tolist():
        a, z = np.searchsorted(spans.page, [p, p + 1]).tolist()
        made, lines = _one_page(spans.take(np.arange(a, z)), body, width)
        found += [((p, k), bounds, table) for k, (bounds, table) in enumerate(made)]
        used.append(lines)
    found.sort(key=lambda f: f[0])
    return [(p, bounds, table) for (p, _), bounds, table in found], np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(u, np.int64) for u in used)]))


def _many_pages(s: Spans, raw: pa.Array, body: float, width: float, odd: np.ndarray) -> tuple[list, list]:
    """Tables as ((page, place), bounds, table), and arrays of lines; pages with blocks side by side are marked as odd and left."""
    cells, cell_row = _rows(_cells(s, raw, body))
    u, row = _united(cells, cell_row, body)
    cell_at, at = heads(cell_row), heads(row)
    page, n = u.page[at], np.diff(at, append=len(row))
    x0, y0, x1, y1 = np.minimum.reduceat(u.x0, at), np.minimum.reduceat(u.y0, at), np.maximum.reduceat(u.x1, at), np.maximum.reduceat(u.y1, at)
    height = np.maximum(1.0, y1 - y0)

    narrow = np.flatnonzero((n == 1) & (x1 - x0 < 0.3 * width))
    if len(narrow):
        centre = (y0 + y1) / 2
        narrow = narrow[np.lexsort((centre[narrow], page[narrow]))]
        first = heads(page[narrow])
        most = np.repeat(np.maximum.reduceat(height[narrow], first), np.diff(first, append=len(narrow)))
        odd[page[narrow[_follows(page[narrow]) & (centre[narrow] - _before(centre[narrow]) <= 0.4 * most)]]] = True

    chars = pc.utf8_length(u.text).to_numpy(zero_copy_only=False)
    may_be = (n >= 2) & (n <= MOST_CELLS) & (np.maximum.reduceat(chars, at) <= LONGEST) & (np.minimum.reduceat(chars, at) <= SHORTEST) & ~odd[page]
    lone, cand = np.flatnonzero((n == 1) & ~odd[page]), np.flatnonzero(may_be)
    if not len(cand):
        return [], []
    lone, cand = lone[np.lexsort((x0[lone], y0[lone], page[lone]))], cand[np.lexsort((x0[cand], y0[cand], page[cand]))]

    # Runs of candidates; beyond a wide gap below all rows so far nothing goes on, whatever is skipped.
    cp, cy0, cy1, ch = page[cand], y0[cand], y1[cand], height[cand]
    same, gap = _follows(cp), cy0 - _before(cy1)
    apart = ~same | (gap > ROW_GAP * np.maximum(_before(ch), ch))
    far = ~same | (cy0 - _before(running_max(cp, cy1)) > ROW_GAP * np.maximum(_before(running_max(cp, ch)), ch))
    run, part = np.cumsum(apart) - 1, np.cumsum(far) - 1
    start = np.flatnonzero(apart)
    size = np.diff(start, append=len(cand))

    # Columns of runs: left sides that follow one another closely.
    place = np.full(len(n), -1)
    place[cand] = np.arange(len(cand))
    ours = np.flatnonzero(place[row] >= 0)
    of, x = place[row[ours]], u.x0[ours]
    order = np.lexsort((x, run[of]))
    begins = ~_follows(run[of[order]]) | (x[order] - _before(x[order]) > ALIGNED)
    column_at, column = np.flatnonzero(begins), np.empty(len(ours), np.int64)
    column[order] = np.cumsum(begins) - 1
    column_end = np.append(column_at[1:], len(ours))
    column_run = run[of[order[column_at]]]
    column_first = np.searchsorted(column_run, np.arange(len(start)))
    columns = np.diff(column_first, append=len(column_at))
    wide = x[order[column_end - 1]] - x[order[column_at]] >= ALIGNED - _SLACK
    hit = np.minimum.reduceat(of[order], column_at)[column] < of

    # A run is a group if each of its rows stands below the one before, on two columns of those before, and over them.
    right, left = _before(running_max(run, x1[cand])), -_before(running_max(run, -x0[cand]))
    in_line = (gap >= -0.3 * _before(ch)) & (np.bincount(of, hit, len(cand)) >= 2) & (np.minimum(x1[cand], right) > np.maximum(x0[cand], left))
    skips = np.zeros(len(start), bool)
    skips[run[~apart & ~in_line]] = True
    skips[column_run[wide]] = True
    skips[run[of[_follows(of) & _follows(column)]]] = True
    skips &= size > 1
    mixed = np.zeros(part[-1] + 1, bool)
    mixed[part[start[skips]]] = True
    plain = ~mixed[part[start]]

    def rows_of(some: np.ndarray) -> list[Row]:
        out = []
        for r in some.tolist():
            a, z, ca, cz = at[r], at[r] + n[r], cell_at[r], cell_at[r + 1] if r + 1 < len(cell_at) else len(cell_row)
            lines = frozenset(cells.line[ca:cz].tolist())
            boxes = zip(u.x0[a:z].tolist(), u.y0[a:z].tolist(), u.x1[a:z].tolist(), u.y1[a:z].tolist(), strict=True)
            out.append(Row([Cell(b, t, bold, lines) for b, t, bold in zip(boxes, u.text.slice(a, z - a).to_pylist(), u.bold[a:z].tolist(), strict=True)]))
        return out

    found, used = [], []

    def one_group(p: int, first: int, group: list[Row], box: Rect) -> None:
        top, bottom = min(r.box[3] for r in group) - 1, max(r.box[3] + BELOW_LAST * r.height for r in group)
        near = slice(*np.searchsorted(lone_page, [p, p + 1]))
        ys = y0[lone[near]]
        others = lone[near][np.searchsorted(ys, top) : np.searchsorted(ys, bottom, "right")]
        if made := table_of(group, rows_of(others)):
            found.append(((p, first), box, made[0]))
            used.append(list(made[1].union(*(r.lines for r in group))))

    lone_page = page[lone]
    for a, z in zip(*(np.searchsorted(part, np.flatnonzero(mixed), side) for side in ("left", "right")), strict=True):
        rows = rows_of(cand[a:z])
        number = {id(r): a + k for k, r in enumerate(rows)}
        for group in row_groups(rows):
            own = cand[[number[id(r)] for r in group]]
            one_group(int(cp[a]), number[id(group[0])], group, (float(x0[own].min()), float(y0[own].min()), float(x1[own].max()), float(y1[own].max())))

    # A row alone must be a stat line, which holds an abbreviation.
    named = np.zeros(len(start), bool)
    single = (size == 1) & plain
    alone = np.flatnonzero(single[run[of]])
    named[run[of[alone[pc.match_substring_regex(u.text.take(pa.array(ours[alone])), ABBR).to_numpy(zero_copy_only=False)]]]] = True
    # So do first cells of a table of stat lines, all in even rows of four or more.
    leads = pc.is_in(u.text.take(pa.array(at[cand])), value_set=_NAMES).to_numpy(zero_copy_only=False)
    stats = np.logical_and.reduceat(leads & (n[cand] >= 4) & (n[cand] % 2 == 0), start)
    # A line of one cell may go on below a row, unless it stands on the first column.
    below = np.zeros(len(start), bool)
    many = np.flatnonzero((plain & (size > 1))[run])
    low, high = (_ranks(lone_page, y0[lone], cp[many], y, side) for y, side in ((cy1[many] - 1, False), (cy1[many] + BELOW_LAST * ch[many], True)))
    pairs = np.maximum(high - low, 0)
    below[run[many[pairs > _MOST_BELOW]]] = True  # so that pairs grow with the rows
    pairs[pairs > _MOST_BELOW] = 0
    which = np.repeat(np.arange(len(many)), pairs)
    other = lone[low[which] + np.arange(len(which)) - (np.cumsum(pairs) - pairs)[which]]
    sums = np.add.reduceat(x[order], column_at) / (column_end - column_at)
    below[run[many[which]][~(np.abs(sums[column_first[run[many[which]]]] - x0[other]) <= ALIGNED - _SLACK)]] = True

    slow = np.where(size == 1, named, stats | below) & plain
    fast = plain & (size > 1) & ~slow
    bounds = list(zip(*(f(v[cand], start).tolist() for f, v in ((np.minimum.reduceat, x0), (np.minimum.reduceat, y0), (np.maximum.reduceat, x1), (np.maximum.reduceat, y1))), strict=True))
    for g in np.flatnonzero(slow).tolist():
        a = int(start[g])
        one_group(int(cp[a]), a, rows_of(cand[a : a + size[g]]), bounds[g])

    # All other groups are tables as they stand.
    area = np.where(fast, size * columns, 0)
    base = np.cumsum(area) - area
    grid = np.full(int(area.sum()), "", object)
    told = np.flatnonzero(fast[run[of]])
    g = run[of[told]]
    grid[base[g] + (of[told] - start[g]) * columns[g] + column[told] - column_first[g]] = u.text.take(pa.array(ours[told])).to_numpy(zero_copy_only=False)
    grid = grid.tolist()
    bold = np.logical_and.reduceat(u.bold, at)[cand]
    headed = bold[start] & (np.add.reduceat(bold.astype(np.int64), start) < size)
    counts = np.zeros(len(start), bool)
    lower = told[(column[told] == column_first[g]) & ~apart[of[told]]]
    counts[run[of[lower[pc.match_substring_regex(u.text.take(pa.array(ours[lower])), "^[0-9+−–-]").to_numpy(zero_copy_only=False)]]]] = True
    keep = np.flatnonzero(fast)
    for k, p, a, b, rows, wide_, head, count in zip(keep.tolist(), cp[start[keep]].tolist(), start[keep].tolist(), base[keep].tolist(), size[keep].tolist(), columns[keep].tolist(), headed[keep].tolist(), counts[keep].tolist(), strict=True):
        th = [0] if head or count and not NUMERIC.fullmatch(grid[b]) else []
        found.append(((p, a), bounds[k], {"k": "table", "rows": [grid[i : i + wide_] for i in range(b, b + rows * wide_, wide_)], "th": th}))
    in_table = np.zeros(len(n), bool)
    in_table[cand[fast[run]]] = True
    used.append(cells.line[in_table[cell_row]])
    return found, used
