import random

import pytest
from pyspark.sql import functions as F

from leafwork.functions import glyphs, pages, references, rolls, scan, stats, text
from leafwork.operators import geometry, grids, journal, ordering, paragraphs
from leafwork.sources import worlds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_page_specs(spark):
    parse = lambda spec, n: one(spark, pages.parse_pages(F.lit(spec), F.lit(n)))
    assert parse("", 3) == [0, 1, 2] and parse(None, 2) == [0, 1] and parse("1-2,5,7-", 8) == [0, 1, 4, 6, 7] and parse("3,1-3, -2", 4) == [2, 0, 1]
    for bad in ("9", "x", "3-2", "0"):
        with pytest.raises(Exception, match="invalid pages"):
            parse(bad, 3)
    rows = spark.createDataFrame([(1, p) for p in (7, 0, 1, 2, 4, 6, 0)], "k int, page_no int")
    assert pages.format_pages(rows, "k").first()["spec"] == "1-3,5,7-8"
    assert one(spark, pages.keep_pages(F.array(*map(F.lit, (-1, 0, 3, 2))), F.lit(3))) == [0, 2]


def test_stat_lines(spark):
    table = lambda t: one(spark, stats.stat_table(F.lit(t)))
    six = "FOR 50 CON 60 TAM 70 DES 40 INT 30 POD 55"
    assert table(six) == [["FOR", "CON", "TAM", "DES", "INT", "POD"], ["50", "60", "70", "40", "30", "55"]] == paragraphs.stat_table(six)["rows"]
    names = "STR DEX CON INT WIS CHA 18 (+4) 14 (+2) 12 (+1) 10 (+0) 8 (-1) 9"
    assert table(names) == [names.split()[:6], ["18 (+4)", "14 (+2)", "12 (+1)", "10 (+0)", "8 (-1)", "9"]] == paragraphs.stat_table(names)["rows"]
    for prose in ("FOR uma vez, CON nada mais que prosa", "", "a b c d e f g h"):
        assert table(prose) is None and paragraphs.stat_table(prose) is None
    eight = " ".join(f"{a} {i}" for i, a in enumerate(("FOR", "CON", "TAM", "DES", "INT", "POD", "EDU")))
    assert table(eight) == paragraphs.stat_table(eight)["rows"] and len(table(eight)) == 4 and table(eight)[2][-1] == ""


def test_numerals_and_keys(spark):
    for t, n in (("IV", 4), ("xii", 12), ("17", 17), ("Doze", 12), ("IIII", 4), ("XC", 90), ("três", 3), ("foo", None)):
        assert one(spark, text.chapter_number(F.lit(t))) == n == references.number(t), t
    assert one(spark, text.slugify(F.lit(" Ação & Reação! "))) == "acao-reacao" and one(spark, text.slugify(F.lit("日本"))) == "journal"
    assert one(spark, text.furniture_key(F.lit("  Page  12 of 340 "))) == "page # of #"
    assert [one(spark, text.half_points(F.lit(x))) for x in (10.25, 10.75, 10.3)] == [10.0, 11.0, 10.5]
    assert [one(spark, text.is_page_number(F.lit(x))) for x in ("- 12 -", "xiv", "12345", "page 1", "")] == [True, True, False, False, False]
    assert one(spark, text.clean_cell(F.lit("a-\nb  c­ \n"))) == "ab c" and one(spark, text.clean_cell(F.lit(None))) == ""


def test_glyphs(spark):
    def left(*spans):
        kind = "array<struct<text:string,font:string>>"
        got = spark.createDataFrame([(list(spans),)], f"s {kind}").select(glyphs.without_glyphs(F.col("s")).alias("x")).first()["x"]
        return got and "".join(s["text"] for s in got)

    assert left(("● ", "Serif"), ("item", "Serif")) == "• item" and left(("l", "Wingdings"), ("item", "Serif")) == "• item"
    assert left(("❖ item", "Serif")) == "• item" and left(("❧ ☙", "Serif")) is None and left(("* * *", "Serif")) is None
    assert left(("a — b", "Serif")) == "a — b" and left(("a�b", "Serif")) == "ab" and left(("x", "ZapfDingbats")) is None


def test_references():
    refs = references.References([("Capítulo III: Casa", ".c"), ("Insanidade", ".i"), ("Ataques", ".a"), ("Ataques", ".b")], [(2, "p2")], {42: 2, 43: 9})
    said = lambda t: journal.splice(t, refs.find(t))
    assert said("ver capítulo 3") == "ver @UUID[.c]{capítulo 3}" == said("ver capítulo III").replace("III", "3") and said("see chapter three").startswith("see @UUID[.c]")
    assert said("(veja Insanidade)") == "(veja @UUID[.i]{Insanidade})" and said("veja Insanidades") == "veja Insanidades"
    assert said("ver capítulo 9, ver página 43, veja Ataques") == "ver capítulo 9, ver página 43, veja Ataques" and "@UUID[.p2]{p. 42}" in said("(p. 42)")


def test_rolls():
    said = lambda t: journal.splice(t, rolls.find_rolls(t))
    assert said("Perda de Sanidade: 0/1D6") == "@coc7.sanloss[sanMin:0,sanMax:1D6]{Perda de Sanidade: 0/1D6}"
    assert said("(0/1d6 SAN") == "(@coc7.sanloss[sanMin:0,sanMax:1D6]{0/1d6 SAN}" and said("Luck roll") == "@coc7.check[subtype:attribute,name:lck]{Luck roll}"
    assert "difficulty:++" in said("an Extreme DEX check") and "name:Ciência (Biologia)" in said("teste de Ciência (Biologia)")
    assert "poolModifier:-2" in said("teste de Sorte, com dois dados de penalidade") and said("um teste de nada") == "um teste de nada"
    assert rolls.loss_cell(" 1/1D8 ").endswith("{1/1D8}") and rolls.loss_cell("1D8") is None


def test_html():
    runs = [["a ", True, False, False], [" ", False, False, False], ["b<", True, True, False], ["2", False, False, True]]
    assert journal.runs_html(runs) == "<strong>a</strong> <strong><em>b&lt;</em></strong><sup>2</sup>" and journal.runs_html(runs, True) == "a <em>b&lt;</em><sup>2</sup>"
    assert journal.table_html({"k": "table", "rows": [["", ""], ["a", "b"]], "th": []}, lambda t: [], False) == "<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table>"
    assert journal.splice_runs([["ab", True, False, False], ["cd", False, False, False]], [scan.Span(1, 3, "X")]) == [["aX", True, False, False], ["d", False, False, False]]


def test_rectangles_merge_to_a_fixpoint():
    assert geometry.merge_overlapping([(0, 0, 10, 10), (11, 0, 20, 10), (50, 50, 60, 60), (15, 5, 52, 52)], 2.0) == [(0, 0, 60, 60)]
    assert geometry.merge_overlapping([(0, 0, 10, 10), (13, 0, 20, 10)], 2.0) == [(0, 0, 10, 10), (13, 0, 20, 10)]


def test_merging_against_all_pairs():
    r = random.Random(5)
    for _ in range(400):
        rects = [(x := r.randrange(0, 90), y := r.randrange(0, 90), x + r.randrange(1, 25), y + r.randrange(1, 25)) for _ in range(r.randrange(9))]
        plain, gap = sorted(set(rects)), r.choice([0.5, 2.0])
        meets = lambda a, b: a[0] - gap < b[2] and b[0] < a[2] + gap and a[1] - gap < b[3] and b[1] < a[3] + gap  # noqa: B023, E731
        while pair := next(((a, b) for a in plain for b in plain if a < b and meets(a, b)), None):
            a, b = pair
            plain = sorted({p for p in plain if p not in pair} | {(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))})
        assert sorted(geometry.merge_overlapping(rects, gap)) == plain


def drawn_line(y, cells, bold=False, size=10.0):
    spans = [{"text": t, "font": "Bold" if bold else "", "size": size, "flags": 0, "x0": x, "y0": y, "x1": x + 5.0 * len(t), "y1": y + size} for x, t in cells]
    return {"spans": spans, "bbox": (spans[0]["x0"], y, spans[-1]["x1"], y + size)}


def test_tables_drawn_are_found():
    r = random.Random(9)
    word = lambda n=8: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, n)))
    for _ in range(200):
        block, want, used, y = [], [], set(), 50.0
        for _ in range(r.randrange(1, 4)):
            left = [54 + 100.0 * k for k in sorted(r.sample(range(5), r.randrange(2, 6)))]
            rows = [[word() for _ in left] for _ in range(r.randrange(2, 7))]
            counted = r.random() < 0.5  # numbers below a word make the first row a header
            if counted:
                rows[1:] = [[str(r.randrange(99)), *row[1:]] for row in rows[1:]]
            for row in rows:
                used.add((0, len(block)))
                block.append(drawn_line(y, [(x + r.choice([0, 1, 3]), t) for x, t in zip(left, row, strict=True)]))
                y += r.choice([12.0, 14.0])
            want.append((rows, [0] if counted else []))
            y += 40.0  # a wide line of prose parts tables
            block.append(drawn_line(y, [(54.0, " ".join(word() for _ in range(18)))]))
            y += 40.0
        found, lines = grids.text_tables([block], 10.0, 612.0)
        assert [(t["rows"], t["th"]) for _, t in found] == want and lines == used


def test_columns_set_as_blocks_are_a_table():
    left, right = ["alpha", "beta", "gamma"], ["one", "two", "three"]
    blocks = [[drawn_line(50.0 + 14 * k, [(x, t)]) for k, t in enumerate(column)] for x, column in ((54.0, left), (110.0, right))]
    found, used = grids.text_tables(blocks, 10.0, 612.0)
    assert [t["rows"] for _, t in found] == [[list(p) for p in zip(left, right, strict=True)]] and len(used) == 6
    assert grids.text_tables([blocks[0], [drawn_line(50.0 + 14 * k, [(300.0, t)]) for k, t in enumerate(right)]], 10.0, 612.0) == ([], set())


def test_what_goes_on_below_a_cell_joins_it():
    block = [drawn_line(50.0, [(54.0, "Name"), (160.0, "Note")], bold=True), drawn_line(64.0, [(54.0, "Ana"), (160.0, "a long")]), drawn_line(75.0, [(160.0, "note")]), drawn_line(88.0, [(54.0, "Bea"), (160.0, "short")])]
    found, used = grids.text_tables([block], 10.0, 612.0)
    assert [(t["rows"], t["th"]) for _, t in found] == [([["Name", "Note"], ["Ana", "a long note"], ["Bea", "short"]], [0])] and len(used) == 4


def plainly_ordered(rects, x0, x1):
    """Reading order by plain recursion: numbers of (x0, y0, x1, y1, number)."""
    band, out = [], []
    for r in [*sorted(rects, key=lambda r: (r[1], r[0], r[4])), None]:
        if r is not None and r[2] - r[0] < 0.6 * max(1.0, x1 - x0):
            band.append(r)
            continue
        columns = []
        for b in sorted(band):
            if columns and b[0] <= max(c[2] for c in columns[-1]) + 2:
                columns[-1].append(b)
            else:
                columns.append([b])
        if len(columns) < 2:
            out += [b[4] for b in band]
        else:
            for c in columns:
                out += plainly_ordered(c, min(b[0] for b in c), max(b[2] for b in c))
        out += [r[4]] if r else []
        band = []
    return out


def test_reading_order(spark):
    rects = [(0, 0, 100, 10), (0, 20, 40, 30), (60, 20, 100, 30), (0, 40, 40, 50), (60, 40, 100, 50), (0, 60, 100, 70), (0, 80, 30, 90)]
    drawn, r = [rects, [(420, 444, 480, 534), (315, 686, 435, 726), (315, 644, 375, 656), (310, 20, 500, 60)]], random.Random(3)
    for _ in range(300):
        drawn.append([(x := r.randrange(0, 560, 15), y := r.randrange(0, 700, 12), x + r.randrange(15, 300, 15), y + r.randrange(10, 90, 10)) for _ in range(r.randrange(1, 14))])
    deep = [(0, 0, 4096, 1)]  # columns within columns, a dozen deep
    for k in range(12):
        w = 4096 >> k
        deep += [(w * 0.55, k * 10 + 5, w, k * 10 + 8), (0, k * 10 + 5, w * 0.3, k * 10 + 6)]
    drawn.append(deep)
    kind = "page_no int, item_no int, x0 double, y0 double, x1 double, y1 double, note string"
    rows = spark.createDataFrame([(p, i, *map(float, x), "n") for p, page in enumerate(drawn) for i, x in enumerate(page)], kind)
    got = {}
    for row in ordering.reading_order(rows, ["page_no"]).orderBy("page_no", "place").collect():
        got.setdefault(row["page_no"], []).append(row["item_no"])
    want = {p: plainly_ordered([(*x, i) for i, x in enumerate(page)], min(x[0] for x in page), max(x[2] for x in page)) for p, page in enumerate(drawn)}
    assert got == want and got[0] == [0, 1, 3, 2, 4, 5, 6]


def test_worlds(tmp_path):
    for name in ("zeta", "Arkham", "beta"):
        (tmp_path / "worlds" / name).mkdir(parents=True)
    assert worlds.list_worlds(tmp_path) == ["Arkham", "beta", "zeta"] and worlds.list_worlds(tmp_path / "no") == []
    assert worlds.output_and_prefix("s", "o", "arkham", str(tmp_path)) == (str(tmp_path / "worlds/arkham/leafwork"), "worlds/arkham/leafwork/s")
    assert worlds.output_and_prefix("s", "o", None, None) == ("o", "leafwork/s")
    with pytest.raises(worlds.SettingsError):
        worlds.checked_world("../x")
