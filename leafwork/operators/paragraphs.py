"""Paragraphs of a text block: lines are marked where one starts, then what lies between marks is joined."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from leafwork.functions.stats import ABBR, VALUE, COVERED, LEAST_PAIRS, ONE_ROW

# Markers of lists, labels of sheets, ends of sentences, names of fonts.
BULLET = re.compile(r"\s*[•●▪■◦○▸►–—*·-]\s+")
ORDERED = re.compile(r"\s*(?:\d{1,3}|[a-zA-Z])[.)]\s+")
LABELLED = re.compile(r"[A-ZÀ-Ý][\wÀ-ÿ%/()' -]{1,32}:\s*\S")
ENDS = tuple('.!?:…"”»)')
BOLD_FONT, ITALIC_FONT = re.compile("bold|black|heavy|semibold", re.I), re.compile("italic|oblique", re.I)
PAIR = re.compile(rf"(?<!\w)({ABBR})\s*:?\s*({VALUE})(?!\w)")
NAME, NUMBER = re.compile(f"(?:{ABBR})"), re.compile(VALUE)
SOFT_HYPHEN = "\xad"


class Line(NamedTuple):
    """A line as read: runs [text, bold, italic, sup], bounds, dominant size, whether all is bold, kind."""

    runs: list
    bbox: tuple
    size: float
    bold: bool
    kind: str

    @property
    def text(self) -> str:
        return "".join(r[0] for r in self.runs)

    @property
    def mark(self) -> int:
        """How many characters a list marker takes."""
        found = BULLET.match(self.text) or ORDERED.match(self.text)
        return found.end() if found else 0


def plain(block: dict) -> str:
    return "".join(r[0] for r in block.get("runs", ()))


def rejoin(lines: list[dict]) -> list[dict]:
    """Fragments at one height, each right of the one before, made one line."""
    groups: list[list[dict]] = []
    y0 = y1 = reach = 0.0
    for ln in lines:
        a0, b0, a1, b1 = ln["bbox"]
        if groups and a0 >= reach - 1 and abs(y0 + y1 - b0 - b1) < 0.8 * max(1.0, y1 - y0):
            groups[-1].append(ln)
            y0, y1 = min(y0, b0), max(y1, b1)
        else:
            groups.append([ln])
            y0, y1 = b0, b1
        reach = a1
    return [g[0] if len(g) == 1 else {"spans": [s for ln in g for s in ln["spans"]], "bbox": (g[0]["bbox"][0], min(ln["bbox"][1] for ln in g), g[-1]["bbox"][2], max(ln["bbox"][3] for ln in g))} for g in groups]


def read_line(ln: dict, body: float, levels: dict[float, int]) -> Line | None:
    """A line's runs, dominant size and weight; None without visible text."""
    runs, chars, bold_all, reach = [], Counter(), True, None
    for s in ln["spans"]:
        text = s["text"].replace(SOFT_HYPHEN, "")
        if not text:
            continue
        apart = reach is not None and s["x0"] - reach > 0.2 * s["size"]
        if apart and " " not in (runs[-1][0][-1:], text[0]):
            runs[-1][0] += " "
        reach = s["x1"]
        font = s["font"] or ""
        form = [bool(s["flags"] & 16 or BOLD_FONT.search(font)), bool(s["flags"] & 2 or ITALIC_FONT.search(font)), bool(s["flags"] & 1) and s["size"] < 0.9 * body]
        runs.append([text, *form])
        if visible := len(text.strip()):
            chars[round(s["size"] * 2) / 2] += visible
            bold_all = bold_all and form[0]
    if not chars:
        return None
    size, whole = chars.most_common(1)[0][0], "".join(r[0] for r in runs).strip()
    kind = "dropcap" if len(whole) <= 2 and whole.isalpha() and size >= 1.8 * body else f"h{levels[size]}" if size in levels else "p"
    return Line(runs, ln["bbox"], size, bold_all, kind)


def starts(read: list[Line]) -> list[bool]:
    """Where a paragraph, list item, heading or drop cap starts.

    Some lines start one whatever is open: of another kind, with a marker, below a gap. Between
    those, lines go on in a list item and in a heading; in a paragraph, looks decide: in a sheet of
    labels a capital, elsewhere an indent, a label after a label, a capital after a short line
    that ends a sentence, or plain text below a bold line that is a paragraph alone.
    """
    left, right = min(x.bbox[0] for x in read), max(x.bbox[2] for x in read)
    texts, marks = [x.text.strip() for x in read], [x.mark for x in read]
    labelled = [bool(LABELLED.match(t)) for t in texts]
    sheet = sum(labelled) >= max(2, 0.4 * len(read))
    pairs = list(zip(read, read[1:], strict=False))
    hard = [True] + [b.kind != a.kind or b.kind == "dropcap" or b.kind == "p" and (m > 0 or b.bbox[1] - a.bbox[3] > 0.7 * b.size) for (a, b), m in zip(pairs, marks[1:], strict=True)]
    capital = [t[:1].isupper() or t[:1].isdigit() for t in texts]
    if sheet:
        looks = [False] + [c and not a.text.rstrip().endswith(("-", ",", "(")) for (a, _), c in zip(pairs, capital[1:], strict=True)]
        turns = [False] * len(read)
    else:
        indent = [x.bbox[0] > left + max(6, 0.8 * x.size) for x in read]
        short = [x.text.rstrip().endswith(ENDS) and x.bbox[2] < right - 3 * y.size for x, y in pairs]
        looks = [False] + [indent[k] or labelled[k - 1] and labelled[k] or capital[k] and short[k - 1] for k in range(1, len(read))]
        turns = [False] + [a.bold and not b.bold for a, b in pairs]
    free, out = False, []
    for k, line in enumerate(read):
        if hard[k]:
            free = line.kind == "p" and not marks[k]  # a paragraph is open, no item or heading
        # a line that turns from bold follows a bold one, which doesn't turn: so what starts there is known
        out.append(hard[k] or free and (looks[k] or turns[k] and out[k - 1]))
    return out


def joined(lines: list[Line], skip: int) -> list[list]:
    """The runs of lines without their first characters; a hyphen before a small letter goes, else a blank parts lines."""
    runs: list[list] = []
    for line in lines:
        own = [list(r) for r in line.runs]
        if runs:
            own[0][0] = own[0][0].lstrip()
            last = runs[-1][0].rstrip()
            if re.search(r"[^\W\d_]-$", last) and own[0][0][:1].islower():
                runs[-1][0] = last[:-1]
            elif not runs[-1][0].endswith(" "):
                runs[-1][0] = last + " "
        else:
            while own and skip >= len(own[0][0]):
                skip -= len(own.pop(0)[0])
            if own:
                own[0][0] = own[0][0][skip:]
        runs += own
    return runs


def stat_table(text: str) -> dict | None:
    """The table that a stat line is."""
    text = " ".join(text.split())
    found = list(PAIR.finditer(text))
    solid = lambda t: len(t.replace(" ", ""))
    if len(found) >= LEAST_PAIRS and sum(solid(m[0]) for m in found) >= COVERED * solid(text):
        width = len(found) if len(found) <= ONE_ROW else -(-len(found) // 2)
        return header_pairs([[m.groups() for m in found[i : i + width]] for i in range(0, len(found), width)], width)
    words = re.findall(rf"{VALUE}|\S+", text)
    names, values = words[: len(words) // 2], words[len(words) // 2 :]
    if len(names) >= LEAST_PAIRS and len(names) == len(values) and all(map(NAME.fullmatch, names)) and all(map(NUMBER.fullmatch, values)):
        return {"k": "table", "rows": [names, values], "th": [0]}
    return None


def header_pairs(groups: list[list], width: int) -> dict:
    """A table with a header row of names above a row of values for each group of pairs."""
    rows = [[*column, *[""] * (width - len(group))] for group in groups for column in zip(*group, strict=True)]
    return {"k": "table", "rows": rows, "th": list(range(0, len(rows), 2))}


def _block(lines: list[Line]) -> dict | None:
    """The block that lines between two starts are."""
    first = lines[0]
    item = first.kind == "p" and first.mark > 0
    runs = joined(lines, first.mark if item else 0)
    if runs:
        runs[0][0], runs[-1][0] = runs[0][0].lstrip(), runs[-1][0]
        runs[-1][0] = runs[-1][0].rstrip()
    kind, text = "li" if item else first.kind, "".join(r[0] for r in runs)
    if not text.strip():
        return None
    if kind == "p":
        if table := stat_table(text):
            return table
        title = len(lines) == 1 and len(text.strip()) < 70 and text.strip()[-1] not in ".,;:" and all(r[1] for r in runs if r[0].strip())
        kind = "h4" if title else kind
    if kind.startswith("h") and len(text) > 200:
        kind = "p"
    return {"k": kind, "runs": runs, "ordered": bool(item and ORDERED.match(first.text)), "lines": len(lines)}


def paragraphs(lines: list[dict], body: float, levels: dict[float, int]) -> list[dict]:
    """Blocks of one text block's lines."""
    read = [x for ln in rejoin(lines) if (x := read_line(ln, body, levels))]
    if not read:
        return []
    cuts = [k for k, new in enumerate(starts(read)) if new]
    return [b for a, z in zip(cuts, [*cuts[1:], len(read)], strict=True) if (b := _block(read[a:z]))]
