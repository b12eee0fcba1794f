"""Main text of HTML pages: the maximum-scoring contiguous region of words and tags.

A page is read once into a sequence of tags and pieces of text. Words score positive and tags
negative, by weights learnt from labelled pages (pages that mark their article; what lies inside
is content): a tag costs little if it stands in content, much if outside; a word earns by how
often words directly in such a block are content, and costs where they mostly aren't. Words in elements that
never are content (menus, adverts, forms, comments ...), and words outside the article of a page
that marks one, score negative. Within a marked article neither tags nor words of such elements
cost anything, so that the region spans the article from its first word to its last. A linear scan
finds the region of the largest sum; its text, without such elements, is the main text.

Character references are decoded; a tag of a block, or a line break, parts words, an inline tag
doesn't; runs of white space become one space.

Edge cases: a null or empty page, or one without words in its region, has an empty text; a page
without tags is all text; an element left open ends with the page, and one of the kinds left out
also where an article or main starts or ends; scripts, styles and comments left open swallow the
rest; pages are read whole; repeated rows repeat; other columns than page_id, url and html are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import arrow_map, text_slices

#: Labelled pages that the weights are fitted on at most, and the characters of one at most.
SAMPLE = 400
SAMPLE_CHARS = 200_000
WORD = 1.0
OUTSIDE = -1.5
#: Words of elements that are left out, where no article is marked: content may go on after them.
LEFT_OUT = -0.4
LEAST, MOST, UNKNOWN = 0.05, 4.0, 0.2

# Elements that are read over, that aren't content, and that don't part words.
RAW = frozenset("script style noscript template title textarea svg math iframe object select xmp noembed noframes".split())
NOT_CONTENT = frozenset("nav aside footer form head button dialog menu label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
# Words in class, id or role that mark such elements.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus feedback footer gdpr masthead menu nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promoted related respond replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget modal alert contentinfo complementary search".split()
)
# Of these, the kinds that may hold articles of their own; the others end where an article starts.
HOLDERS = frozenset("aside footer dialog comment comments disqus feedback related respond replies reply sidebar complementary widget promoted sponsored".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Words that may stand beside these in a name of a class or id without giving it another meaning.
BESIDE = frozenset(
    "area bar block body bottom box button buttons card center column container content desktop entry extra feed fixed form global group header icon icons inner item items left link links list main mobile outer page panel "
    "post posts primary reader right row secondary section site slot social text thread title top unit user users wrap wrapper js is has".split()
)
_NAMES = re.compile(r"\S+")
_PARTS = re.compile(r"[a-z]+")
_ATTRIBUTE_END = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Token(NamedTuple):
    """A tag (name, with / before it if it ends an element) or a piece of text, and where it stands.

    ``within`` is the block that holds a text directly.
    """

    tag: str
    text: str
    left_out: bool
    in_article: bool
    within: str = ""


def _marked(attributes: str) -> set[str]:
    """The words of class, id and role that mark what isn't content: of each name as a whole, so ``share-buttons`` is one and ``price-share-news`` isn't."""
    found: set[str] = set()
    for m in _MARKS.finditer(attributes):
        for name in _NAMES.findall(m[1] or m[2] or m[3] or ""):
            words = set(_PARTS.findall(_ATTRIBUTE_END.sub("-", name).lower()))
            told = words & MARKED
            if told and all(w in MARKED or w in BESIDE or len(w) == 1 for w in words):
                found |= told
    return found


def _tags(page: str):
    """(start, end, closing, name, attributes) of each tag; comments and the like have no name."""
    at, end = 0, len(page)
    while (at := page.find("<", at)) >= 0:
        nxt = page[at + 1 : at + 2]
        if nxt.isalpha() or nxt == "/":
            m = _TAG.match(page, at) or _LOOSE.match(page, at)
            if m is None:
                if nxt == "/" and not page[at + 2 : at + 3].isalpha():
                    stop = page.find(">", at)
                    if stop < 0:
                        return
                    yield at, stop + 1, "", "", ""
                    at = stop + 1
                    continue
                if page.find(">", at) < 0:
                    yield at, end, "", "", ""  # a tag cut off by the page's end
                    return
                at += 1
                continue
            yield at, m.end(), m[1], m[2].lower(), m[3]
            at = m.end()
            if not m[1] and m[2].lower() in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(m[2])}(?![a-zA-Z])", re.I).search(page, at)
                stop = close.start() if close else end
                yield at, stop, "", "", ""
                at = stop
        elif nxt in ("!", "?"):
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 2)
                stop = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", at)
                stop = end if stop < 0 else stop + 1
            yield at, stop, "", "", ""
            at = stop
        else:
            at += 1


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    left_by, depth, article, seen, holder = "", 0, 0, False, False
    done = 0
    open_: list[str] = []

    def piece(stop: int) -> None:
        if stop > done:
            text = page[done:stop]
            out.append(Token("", html.unescape(text) if "&" in text else text, bool(left_by), article > 0, open_[-1] if open_ else ""))

    for start, stop, closing, name, attributes in _tags(page):
        piece(start)
        done = stop
        if not name:
            continue
        void = name in VOID or attributes.endswith("/")
        if not void and name not in INLINE:
            if not closing:
                if open_ and open_[-1] == name and name in CLOSED_BY_NEXT:
                    open_.pop()
                open_.append(name)
            elif name in open_:
                while open_.pop() != name:
                    pass
        marked = _marked(attributes) if attributes and not closing and not void else set()
        if name in ("article", "main") and not marked:
            if not closing and not (left_by and (seen or holder)):
                left_by, depth, seen = "", 0, True
                article += 1
            elif closing and left_by == name:
                depth -= 1
                left_by = left_by if depth else ""
            elif not closing and left_by == name:
                depth += 1
            elif closing and not (left_by and holder):
                article, left_by, depth = max(0, article - 1), "", 0
        elif left_by:
            if name == left_by and not void:
                depth += -1 if closing else 1
                if depth == 0:
                    left_by = ""
                    out.append(Token("/" + name, "", True, article > 0))
                    continue
            elif closing and name == "body":
                left_by = ""
        elif not closing and not void and (name in NOT_CONTENT or marked and name not in ("body", "html") or name == "header" and not article):
            left_by, depth, holder = name, 1, name in HOLDERS or not HOLDERS.isdisjoint(marked)
        out.append(Token(closing + name, "", bool(left_by), article > 0))
    piece(len(page))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> dict[str, float]:
    """What each tag costs, and what a word earns by the block that holds it (``#p``), from at most ``sample`` different pages that mark their article, drawn by a hash.

    The hashes alone are ordered; only the pages below the last one drawn reach the driver.
    """
    labelled = pages.where(F.col("html").rlike("(?i)<article|<main") & (F.length("html") <= chars)).select(F.xxhash64("html").alias("h"), "html")
    last = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = labelled.where(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html")) if last is not None else labelled.limit(0)
    inside, outside = {}, {}
    for (page,) in drawn.select("html").collect():
        for t in tokens(page):
            own = inside if t.in_article and not t.left_out else outside
            key, times = (t.tag, 1) if t.tag else (f"#{t.within}", len(t.text.split()))
            own[key] = own.get(key, 0) + times
    weights = {}
    for key in inside | outside:
        good, bad = inside.get(key, 0), outside.get(key, 0)
        if key[0] == "#":
            weights[key] = WORD * (good - bad) / (good + bad + 2.0)
        elif good + bad:
            weights[key] = LEAST + (MOST - LEAST) * (bad / (good + bad + 2.0)) ** 2
    return weights


def scores(read: list[Token], weights: dict[str, float]) -> list[float]:
    """What each tag costs and each text earns, by the learnt weights and by what the page marks.

    Between the first and the last of several marked articles nothing costs anything.
    """
    marked = [i for i, t in enumerate(read) if t.in_article]
    first, last = (marked[0], marked[-1]) if marked else (len(read), -1)
    out = []
    for i, t in enumerate(read):
        if t.tag:
            out.append(0.0 if first <= i <= last else -(LEAST if t.left_out else weights.get(t.tag, UNKNOWN)))
            continue
        n, learnt = len(t.text.split()), weights.get(f"#{t.within}", WORD)
        if marked:
            word = OUTSIDE if not first <= i <= last else WORD if t.in_article and not t.left_out else 0.0
        else:
            word = min(LEFT_OUT, learnt) if t.left_out else learnt
        out.append(n * word)
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """Where the contiguous part of the largest sum starts and ends: one scan; (0, 0) if no sum is above 0."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total > best:
            best, found = total, (begin, i + 1)
        if total < 0:
            total, begin = 0.0, i + 1
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    read = tokens(page) if page else []
    begin, end = best_region(scores(read, weights))
    marks = any(t.in_article for t in read)
    parts = []
    for t in read[begin:end]:
        if t.tag:
            if t.tag.removeprefix("/") not in INLINE:
                parts.append(" ")
        elif not t.left_out and (t.in_article or not marks):
            parts.append(t.text)
    return " ".join("".join(parts).split())


def extract_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in text_slices(batches, "html"):
            texts = [extract(x, weights) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")
