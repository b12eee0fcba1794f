"""Licences within lines, several articles on a page, and judgements of urls, beside plain versions."""

import random
import re

from leafwork.llm import html_extract, license_scan
from test_operators import documents, prose


# -- 2 -------------------------------------------------------------------------------------
def test_several_articles_and_what_stands_between(spark):
    page = f"<nav>Menu</nav><article><h2>One</h2><p>{'ten ' * 10}</p></article><p>{'out ' * 40}</p><div class=sidebar>{'side ' * 9}</div><article><p>{'two ' * 20}</p></article><footer>f</footer>"
    assert html_extract.extract(page, {}) == "One " + "ten " * 10 + ("two " * 20).strip()
    assert html_extract.extract(page, {"p": 9.0, "#p": -5.0, "div": 9.0}) == html_extract.extract(page, {})
    twice = "<article><p>a b</p></article><article><p>a b</p></article>"
    assert html_extract.extract(twice, {}) == "a b a b"


def test_names_of_classes_as_a_whole():
    page = lambda c: html_extract.extract(f'<article><p>a b c</p><div class="{c}">d e</div><p>f</p></article>', {})
    for name in ("price-share-news", "reply-to-critics", "label-search-results", "advert-law", "menu-of-the-day", "related-science", "bread", "commentary"):
        assert page(name) == "a b c d e f"
    for name in ("ad", "share-buttons", "comment-list", "adSlot", "x related-posts", "cookie_banner", "site-footer", "sidebar2"):
        assert page(name) == "a b c f"


def test_weights_learnt_elsewhere_change_what_is_found():
    page = f"<div><p>{'word ' * 30}</p></div><ul><li>{'item ' * 10}</li></ul>"
    kind, hostile = html_extract.extract(page, {"#p": 1.0, "#li": -1.0}), html_extract.extract(page, {"#p": -1.0, "#li": 1.0})
    assert kind == ("word " * 30).strip() and hostile == ("item " * 10).strip()


# -- 4 -------------------------------------------------------------------------------------
def plain_sequence(text):
    """Identifiers of known sentences in a list of words, longer sentences marking their words first."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    taken = [None] * len(words)
    for known, name in sorted(((license_scan.normal(v).split(), k) for k, v in license_scan.SENTENCES.items()), key=lambda x: -len(" ".join(x[0]) + " " * len(x[0]))):
        i = 0
        while i + len(known) <= len(words):
            if words[i : i + len(known)] == known and not any(taken[i : i + len(known)]):
                taken[i : i + len(known)] = [name] + [""] * (len(known) - 1)
                taken = [x if x is None else x or "-" for x in taken]
                i += len(known)
            else:
                i += 1
    return "".join(f"<{x}>" for x in taken if x and x != "-")


def plain_licences(text):
    seq, found = plain_sequence(text or ""), {}
    for name, ids in license_scan.RULES:
        pattern = "".join(f"<{k}>" for k in ids)
        n = seq.count(pattern)
        seq = seq.replace(pattern, "|")
        if n:
            found[name] = found.get(name, 0) + n
    return found


def test_sentences_within_lines(spark):
    texts = ["This file is Released under the MIT License.", "(c) Foo - Released under the MIT License", "Released under the MIT License (see LICENSE)", "unreleased under the mit licensed", None, ""]
    got = {r["doc_id"]: (r["license"], r["n"]) for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got == {0: ("MIT", 1), 1: ("MIT", 1), 2: ("MIT", 1)}


def test_licences_against_plain_words(spark):
    r, known = random.Random(5), list(license_scan.SENTENCES.values())
    texts = []
    for k in range(150):
        parts = [r.choice([*known, *known, "Released under the MIT", "word", "License", prose(k, 4), "\n * "]) for _ in range(r.randrange(1, 9))]
        text = r.choice([" ", ". ", "\n# ", "  "]).join(parts)
        texts.append(text.upper() if k % 5 == 0 else text.replace(" ", "\n") if k % 7 == 0 else text)
    texts += ["All rights reserved " * 3000, ("Licensed under CC BY 4.0 " * 2 + prose(1, 50) + " ") * 400, texts[0], texts[0]]
    got = {}
    for row in license_scan.scan(documents(spark, texts)).collect():
        got.setdefault(row["doc_id"], {})[row["license"]] = row["n"]
    assert got == {i: w for i, t in enumerate(texts) if (w := plain_licences(t))}
