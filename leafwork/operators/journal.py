"""A document's stream of blocks made into journal pages: tidied, split, linked, rendered."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Callable, Iterable
from itertools import dropwhile, groupby

from leafwork.functions import rolls as R
from leafwork.functions.references import References, anchor
from leafwork.functions.references import plain as squeeze
from leafwork.functions.scan import Span, disjoint
from leafwork.operators.paragraphs import ENDS, plain

#: Fixed value: the version of the program that journals are for.
CORE_VERSION = "13.351"


def is_heading(b: dict | None) -> bool:
    return bool(b) and b["k"][0] == "h"


def without_repeats(blocks: list[dict]) -> list[dict]:
    """Headings at the top of a page that repeat the last heading before it are dropped."""
    told = lambda b: (b["k"], squeeze(plain(b)).casefold())
    tops = [k for k, b in enumerate(blocks) if b["k"] == "break"]
    out, title = blocks[: tops[0]] if tops else list(blocks), None
    for a, z in zip(tops, [*tops[1:], len(blocks)], strict=False):
        title = next((told(b) for b in reversed(out) if is_heading(b)), title)
        out += [blocks[a], *dropwhile(lambda b: is_heading(b) and told(b) == title, blocks[a + 1 : z])]
    return out


def with_capitals(blocks: list[dict]) -> list[dict]:
    """Drop caps put before the next text, in its first run's weight; one with no text after it is lost."""
    out, capital = [], ""
    for b in blocks:
        if b["k"] == "dropcap":
            capital += plain(b).strip()
        elif capital and b.get("runs"):
            first = b["runs"][0]
            out.append(b | {"runs": [[capital, first[1], first[2], False], *b["runs"]]})
            capital = ""
        else:
            out.append(b)
    return out


def before(out: list[dict], across: bool) -> int | None:
    """The place of the last block; over breaks, if they may be crossed."""
    k = len(out) - 1
    while across and k >= 0 and out[k]["k"] == "break":
        k -= 1
    return k if k >= 0 else None


def with_joins(blocks: list[dict], across: bool) -> list[dict]:
    """Paragraphs that go on with a small letter joined to the text before; boxes joined to the box before the page's top."""
    out: list[dict] = []
    for b in blocks:
        k = before(out, across)
        last = out[k] if k is not None else {"k": ""}
        if b["k"] == "p" and last["k"] in ("p", "li") and goes_on(plain(last), plain(b)):
            out[k] = last | {"runs": [*last["runs"], [" ", False, False, False], *b["runs"]]}
        elif b["k"] == "box" and last["k"] == "box" and k < len(out) - 1 and not is_heading(next(iter(b["children"]), None)):
            out[k] = {"k": "box", "children": tidy(last["children"] + b["children"], False)}
        else:
            out.append({"k": "box", "children": tidy(b["children"], False)} if b["k"] == "box" else b)
    return out


def tidy(blocks: list[dict], across: bool) -> list[dict]:
    """Repeated titles dropped, drop caps put before their texts, broken paragraphs and boxes joined.

    ``across``: whether paragraphs and boxes are joined over page breaks.
    """
    return with_joins(with_capitals(without_repeats(blocks)), across)


def goes_on(first: str, then: str) -> bool:
    """Whether a text ends without a sentence's end and the next starts small."""
    return bool(first.strip()) and not first.rstrip().endswith(ENDS) and then.lstrip()[:1].islower()


def split(stream: list[dict], mode: str, level: int, name: str) -> list[dict]:
    """Journal pages (title, blocks, pdf_pages): one for each page, for each heading of the level or above, or one in all."""
    blocks = tidy(stream, mode != "page")
    at_break = lambda b: b["k"] == "break"
    opens = {"page": at_break, "heading": lambda b: is_heading(b) and int(b["k"][1:]) <= level, "none": lambda b: False}[mode]
    cuts = [k for k, b in enumerate(blocks) if opens(b)]
    if mode != "page":
        cuts = [-1, *cuts]  # what stands before the first heading has the journal's name
    pages, seen = [], []
    for a, z in zip(cuts, [*cuts[1:], len(blocks)], strict=False):
        numbers = [b["n"] for b in blocks[max(a, 0) : z] if at_break(b)]
        own = [b for b in blocks[a + 1 : z] if not at_break(b)]
        if mode == "page":
            title = f"Página {blocks[a]['n']}"
            if own and is_heading(own[0]):
                title = squeeze(plain(own.pop(0)))
            keep = bool(own or title)
        else:
            title = name if a < 0 else squeeze(plain(blocks[a]))
            keep = bool(own) or title != name
            numbers, seen = (seen[-1:] if a >= 0 else []) + numbers, seen + numbers
        pages.append((keep, {"title": title, "blocks": own, "pdf_pages": numbers}))
    kept = [p for keep, p in pages if keep]
    return kept or [p for _, p in pages[-1:] if mode != "page"]


def headings(blocks: Iterable[dict]) -> Iterable[str]:
    for b in blocks:
        if b["k"] == "box":
            yield from headings(b["children"])
        elif is_heading(b):
            yield squeeze(plain(b))


def annotator(pages: list[dict], printed: dict[int, int], with_rolls: bool, with_links: bool) -> Callable[[str], list[Span]]:
    """Replacements in a text: rolls, and the links that meet none."""
    names = [x for p in pages for x in [(p["title"], f".{p['id']}"), *((h, f".{p['id']}#{anchor(h)}") for h in headings(p["blocks"]))]]
    refs = References(names, [(n, p["id"]) for p in pages for n in p["pdf_pages"]], printed) if with_links else None

    def annotate(text: str) -> list[Span]:
        found = R.find_rolls(text) if with_rolls else []
        return sorted(found + disjoint(refs.find(text) if refs else (), found))

    return annotate


def splice(text: str, spans: list[Span]) -> str:
    for s in reversed(spans):
        text = text[: s.start] + s.text + text[s.end :]
    return text


def splice_runs(runs: list[list], spans: list[Span]) -> list[list]:
    """Replacements over runs: each takes the form of the run where it starts."""
    if not spans:
        return runs
    chars = [(c, r[1:]) for r in runs for c in r[0]]
    pieces, at = [], 0
    for s in spans:
        pieces += chars[at : s.start] + [(s.text, chars[s.start][1])]
        at = s.end
    pieces += chars[at:]
    return [["".join(c for c, _ in g), *form] for form, g in groupby(pieces, key=lambda p: p[1])]


def runs_html(runs: list[list], heading: bool = False) -> str:
    """Runs as HTML: equal forms joined, blanks outside of marks, no bold in headings."""
    forms: list[tuple] = []
    shown = [r for r in runs if r[0]]
    for text, bold, italic, sup in shown:  # blanks look like what stands before them
        forms.append(forms[-1] if forms and not text.strip() else (bold and not heading, italic, sup))
    out = []
    for form, group in groupby(zip(forms, shown, strict=True), key=lambda p: p[0]):
        text = "".join(r[0] for _, r in group)
        lead, core, tail = re.fullmatch(r"(\s*)(.*?)(\s*)", text, re.S).groups()
        core = html.escape(core, quote=False)
        tags = [tag for on, tag in zip(form, ("strong", "em", "sup"), strict=True) if on and core]
        out.append(lead + "".join(f"<{t}>" for t in tags) + core + "".join(f"</{t}>" for t in reversed(tags)) + tail)
    return squeeze("".join(out))


def table_html(table: dict, annotate: Callable[[str], list[Span]], with_rolls: bool) -> str:
    """A table without its empty rows; cells of a column headed by sanity may be losses."""
    heads = [k in table["th"] for k, r in enumerate(table["rows"]) if any(r)]
    rows = [r for r in table["rows"] if any(r)]
    if not rows:
        return ""
    sanity = [with_rolls and bool(R.SANITY_HEADER.search(c)) and heads[0] for c in rows[0]]

    def linked(k: int, text: str) -> str:
        loss = R.loss_cell(text) if k < len(sanity) and sanity[k] else None
        return loss or splice(text, annotate(text))

    def drawn(row: list[str], head: bool) -> str:
        tag = "th" if head else "td"
        return "<tr>" + "".join(f"<{tag}>{html.escape(c if head else linked(k, c), quote=False)}</{tag}>" for k, c in enumerate(row)) + "</tr>"

    lines = [drawn(r, h) for r, h in zip(rows, heads, strict=True)]
    top = 1 if heads[0] and not any(heads[1:]) else 0
    return "<table>" + ("<thead>" + lines[0] + "</thead>") * top + "<tbody>" + "".join(lines[top:]) + "</tbody></table>"


def render(blocks: list[dict], source: Callable[[str], str], annotate: Callable[[str], list[Span]], with_rolls: bool) -> str:
    parts = []
    told = lambda b: runs_html(splice_runs(b["runs"], annotate(plain(b))))
    for (kind, ordered), group in groupby(blocks, key=lambda b: (b["k"], b["k"] == "li" and b["ordered"])):
        if kind == "li":
            tag = "ol" if ordered else "ul"
            parts.append(f"<{tag}>{''.join(f'<li>{told(b)}</li>' for b in group)}</{tag}>")
            continue
        for b in group:
            if kind == "table":
                parts.append(table_html(b, annotate, with_rolls))
            elif kind == "image":
                parts.append(f'<p><img src="{html.escape(source(b["file"]))}" width="{round(b["w"] * 96 / 72)}"></p>')
            elif kind == "box":
                parts.append(f"<blockquote>{render(b['children'], source, annotate, with_rolls)}</blockquote>")
            elif is_heading(b):
                parts.append(f"<{kind}>{runs_html(b['runs'], True)}</{kind}>")
            elif kind in ("p", "dropcap"):
                parts.append(f"<p>{told(b)}</p>")
    return "\n".join(parts)


def page_id(doc: str, n: int) -> str:
    """Sixteen characters that follow from the document and the page's place: runs can be repeated."""
    return hashlib.sha256(f"{doc}\x1f{n}".encode()).hexdigest()[:16]


def entry(doc: str, name: str, pages: list[dict], source: str, now_ms: int) -> dict:
    stats = {"coreVersion": CORE_VERSION, "createdTime": now_ms, "modifiedTime": now_ms}
    told = [
        {
            "_id": p["id"], "name": p["title"], "type": "text", "title": {"show": True, "level": 1}, "text": {"content": p["html"], "format": 1},
            "sort": (i + 1) * 100000, "ownership": {"default": -1}, "flags": {}, "_stats": stats,
        }
        for i, p in enumerate(pages)
    ]
    return {"_id": page_id(doc, -1), "name": name, "pages": told, "folder": None, "sort": 0, "ownership": {"default": 0}, "flags": {"leafwork": {"source": source}}, "_stats": stats}


def macro(made: dict) -> str:
    """A script that creates the entry when it is run."""
    data = json.dumps({k: v for k, v in made.items() if k not in ("_id", "_stats")}, ensure_ascii=False)
    return f"// Paste into a script macro and run it.\nconst data = {data};\nconst entry = await JournalEntry.create(data);\nentry?.sheet.render(true);\n"


def preview_links(content: str) -> str:
    """Links shown as labelled spans."""
    content = re.sub(r"@coc7\.(\w+)\[([^\]]*)\]\{([^}]*)\}", r'<span class="roll" title="@coc7.\1[\2]">🎲 \3</span>', content)
    return re.sub(r"@UUID\[([^\]]*)\]\{([^}]*)\}", r'<span class="link" title="@UUID[\1]">📄 \2</span>', content)


def preview(name: str, pages: list[tuple[str, str]]) -> str:
    """One page of HTML with an article for each journal page."""
    body = "".join(f"<article><h1>{html.escape(t)}</h1>{preview_links(c)}</article>" for t, c in pages)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(name)}</title><style>article{{max-width:50em;margin:2em auto}}.roll,.link{{background:#eee}}</style></head><body>{body}</body></html>'
