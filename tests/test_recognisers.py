"""The automaton of openers and the mentions it leads to, against plain searches."""

import random

import numpy as np
import pytest

from leafwork.functions import references, rolls, scan
from leafwork.operators import frames, journal


@pytest.mark.parametrize("patterns", [["a", "ab", "bab", "abab"], ["ver", "veja", "(p.", "é", "aa", "aaa"], ["x" * 40, "y"]])
def test_automaton_against_find(patterns, monkeypatch):
    monkeypatch.setattr(scan.Automaton, "WIDTH", 16)
    r = random.Random(4)
    texts = ["", *("".join(r.choice(["a", "b", "é", "ver", "veja ", "(p.", "x" * 20, "z𝄞"]) for _ in range(r.randrange(60))) for _ in range(60)), "x" * 500]
    found = scan.Automaton(patterns)
    points, at = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    want = sorted((t, i, n) for t, text in enumerate(texts) for n, p in enumerate(found.patterns) for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(*(x.tolist() for x in found.find(points, at)), strict=True)) == want
    assert found.opened(texts).tolist() == [any(p in t for p in patterns) for t in texts]
    assert not len(scan.Automaton([]).find(points, at)[0]) and scan.Automaton(["a"]).opened([""]).tolist() == [False]


_PIECES = "ver veja Veja see ( ) , . capítulo Chapter cap. 3 III três p. pág. 42 o a the também \" Insanidade teste de em roll check Hard Extremo Listen Ciência (Biologia) com um dado bônus SAN Sanidade Perda 0/1D6 1 / 1d4 + 1 perdida : –".split(" ")


def test_places_of_grammars_are_enough():
    r = random.Random(7)
    for _ in range(1500):
        text = "".join(r.choice(_PIECES) + r.choice(["", " ", " ", " ", "\n"]) for _ in range(r.randrange(24)))
        w = scan.Words(text)
        whole = range(len(w))
        plain = [(k, x) for k, g in (("sanloss", rolls._told_loss), ("sanloss", rolls._plain_loss), ("check", rolls._asked_check), ("check", rolls._named_check)) for x in scan.scan(w, g, whole)]
        assert [(k, x) for k, g, starts in rolls._starts(w) for x in scan.scan(w, g, starts)] == plain
        said = [(k, w.at[i][0], w.at[j - 1][1], n) for k, g in (("chapter", references._chapter), ("page", references._page)) for _, j, (i, n) in scan.scan(w, g, whole)]
        said += [("see", w.at[i][0], w.at[i][0], None) for _, _, i in scan.scan(w, references._see, whole) if i < len(w)]
        assert references.mentions(text) == said
        assert not plain or rolls.openers().opened([text])[0]
        assert not said or references.openers().opened([text])[0]


def test_references_by_joins_against_the_document_s_own(spark):
    r = random.Random(3)
    names = {d: [(i, r.choice(["Capítulo III: A Casa", "Chapter 4", "Insanidade", "Insanidade Temporária", "Ataques", "Ataques", "ver", "A Casa}"]), f".t{d}-{i}") for i in range(6)] for d in range(8)}
    printed, pages = {d: {42: 9, 43: 10, 44: 77} for d in range(8)}, [(9, 0, "p9"), (10, 1, "p10"), (9, 2, "late")]
    rows = [(d, t, "".join(r.choice([*_PIECES, "Insanidade Temporária", "Ataques", "Chapter 4", "A Casa}", "43"]) + r.choice([" ", " ", ""]) for _ in range(r.randrange(20)))) for d in range(8) for t in range(25)]
    rows += [(0, 100, None), (0, 101, ""), (9, 102, "ver capítulo 3"), (0, 103, "x" * 700 + " (p. 42) " + "y" * 700 + " veja Insanidade")]
    texts = spark.createDataFrame(rows, "doc_id int, text_id int, text string")
    tables = [spark.createDataFrame(x, k) for x, k in (
        ([(d, *n) for d, own in names.items() for n in own], "doc_id int, ord int, name string, target string"), ([(d, n, o, p) for d in names for n, o, p in pages], "doc_id int, pdf_page int, ord int, page_id string"),
        ([(d, n, p) for d, own in printed.items() for n, p in own.items()], "doc_id int, printed int, pdf_page int"),
    )]
    got = {x["text_id"] + 1000 * x["doc_id"]: x["text"] for x in frames.linked_references(texts, *tables).collect()}
    want = {}
    for d, t, text in rows:
        refs = references.References([n[1:] for n in names.get(d, [])], [(n, p) for n, _, p in pages], printed.get(d, {}))
        want[t + 1000 * d] = None if text is None else journal.splice(text, refs.find(text))
    assert got == want and "@UUID[.p9]{p. 42}" in got[103]
    assert frames.linked_references(texts.where("false"), *tables).collect() == []
