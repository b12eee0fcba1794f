"""Vector codes, quality rules and spelling variants on small cases, beside plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafwork.llm import quality_cascade, spelling_variants, vector_codes
from test_operators import documents, prose

VECTORS = "vec_id long, embedding array<double>, label int, id string, entry int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], VECTORS)


# -- 11 ------------------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds):
    """Codes and errors of plain Lloyd on integers, every distance taken."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    w = len(ints[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in ints]
    first = sorted(range(len(ints)), key=lambda k: ints[k])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for step in range(rounds + 1):
        near = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == e]
                    if own:
                        books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((i, bytes(e for _, e in n), sum(d for d, _ in n)) for (i, _), n in zip(ints, near, strict=True)), books


@pytest.mark.parametrize("grid", [0.01, 0.25])  # the coarse grid makes many ties
def test_codes_against_plain_lloyd(spark, grid):
    r = random.Random(3)
    rows = [(i, [round(r.gauss(0, 1) / grid) * grid for _ in range(8)], i % 3) for i in range(300)]
    rows += [(500 + i, rows[i][1], None) for i in range(40)]
    got = vector_codes.compress(vectors(spark, rows), parts=4, entries=24, rounds=3)
    want, books = plain_codes(rows, 4, 24, 3)
    assert sorted((x["id"], bytes(x["codes"]), x["error"]) for x in got.rows.collect()) == want and got.codebooks.tolist() == books
    back = vector_codes.decode(want[0][1], got.codebooks)
    assert sum((math.floor(256 * a) - math.floor(256 * b)) ** 2 for a, b in zip(back, rows[0][1], strict=True)) == want[0][2]


def test_bounds_hold_and_save_distances():
    r = np.random.default_rng(8)
    centres = r.integers(-300, 300, (24, 4))
    x = centres[r.integers(0, 24, 2000)] + r.integers(-9, 9, (2000, 4))
    books = x[:64].copy()
    group = vector_codes.grouped(books)
    entry, upper, lower = vector_codes.Part(books, group, np.zeros(64)).first(x, group.max() + 1)
    taken = []
    for _ in range(4):
        new = np.array([x[entry == e].sum(0) // max(1, (entry == e).sum()) if (entry == e).any() else books[e] for e in range(64)])
        moved = np.sqrt(((new - books) ** 2).sum(1)) * (1 + 1e-9)
        books, part = new, vector_codes.Part(new, group, moved)
        entry, upper, lower, n = part.again(x, entry, upper, lower)
        taken.append(n)
        d = vector_codes.squares(x, books)
        assert (entry == d.argmin(1)).all() and (upper >= np.sqrt(d[np.arange(2000), entry])).all()
        others = np.sqrt(d.astype(float))
        others[np.arange(2000), entry] = np.inf
        assert all((lower[:, g] <= others[:, group == g].min(1)).all() for g in range(group.max() + 1) if (group == g).any())
    assert sum(taken) < 0.5 * 4 * 2000 * 64


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1e300, 0.0], 1)]
    rows = [*odd, (6, [0.5, -0.001], None), (6, [0.5, -0.001], None), (7, [0.25, 0.0, 0.0], 2), (8, [0.0, 0.0], 2), (None, [-1.0, 1.0], 2)]
    found = vector_codes.compress(vectors(spark, rows))
    got = sorted(map(tuple, vector_codes.digest(found).select("vec_id", "error", "label_error").collect()), key=repr)
    assert [x[0] for x in got] == [6, 6, 8, None] and all(x[1:] == (0, 0) for x in got)
    assert found.codebooks.shape == (16, 4, 1) and found.codebooks[:2, 0, 0].tolist() == [128, -1]
    none = vector_codes.compress(vectors(spark, odd))
    assert vector_codes.digest(none).collect() == [] and none.codebooks.size == 0
    assert vector_codes.compress(vectors(spark, [(1, [], 1)])).rows.count() == 1


def test_errors_by_label(spark):
    r = random.Random(4)
    rows = [(i, [r.random() for _ in range(16)], [None, 1, 2][min(2, i % 7)]) for i in range(200)]
    got = vector_codes.digest(vector_codes.compress(vectors(spark, rows), entries=8)).collect()
    label, sums = {i: lab for i, _, lab in rows}, Counter()
    for x in got:
        sums[label[x["vec_id"]]] += x["error"]
    assert all(x["label_error"] == sums[label[x["vec_id"]]] for x in got) and len(got) == 200


# -- 12 ------------------------------------------------------------------------------------
BLANK = "[ \t-\r]"


def plain_measures(text):
    text = text or ""
    words, lines = re.findall("[^ \t-\r]+", text), [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {x for x, n in Counter(threes).items() if n > 1}
    covered = {i + j for i, x in enumerate(threes) if x in many for j in range(3)}
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    bare = [x.strip(" \t\r\f\v") for x in lines]
    return base, dict(
        letters=sum(any(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in w) for w in words), capitals=sum("A" <= c <= "Z" for c in text), small=sum("a" <= c <= "z" for c in text), lines=len(lines),
        bullets=sum(x[0] in "-*•" for x in bare), broken=sum(x.endswith(("...", "…")) for x in bare),
    )


def plain_kept(text):
    (words, chars, symbols, dup, repeat), m = plain_measures(text)
    return not (
        words < 50 or 2 * repeat > words or 10 * symbols > words or not 3 * words <= chars <= 10 * words or 10 * m["letters"] < 8 * words or m["capitals"] > m["small"] or 2 * dup > m["lines"]
        or 10 * m["bullets"] > 9 * m["lines"] or 10 * m["broken"] > 3 * m["lines"]
    )


def odd_texts():
    r, out = random.Random(6), [None, "", " \n\t", "..", ".\n..", "one", "a b c a b c", "\n".join(["same line here"] * 40), "x " * 5000]
    for k in range(120):
        w = prose(k, r.choice([30, 60, 90])).split()
        kind = k % 8
        if kind == 1:
            w = [x + "###" for x in w]
        if kind == 2:
            w = [x.upper() for x in w]
        if kind == 3:
            w = [x if i % 3 else "|" for i, x in enumerate(w)]
        lines = [" ".join(w[i : i + 7]) for i in range(0, len(w), 7)]
        if kind == 4:
            lines = ["• " + x for x in lines]
        if kind == 5:
            lines = [x + r.choice(["...", "…", ".", "...\t"]) for x in lines]
        if kind == 6:
            lines = lines[:3] * 5
        out.append("\n".join(lines))
    return [*out, out[9], " ".join(prose(k) for k in range(3000))]


@pytest.mark.parametrize("sample", [20, 10_000])
def test_rules_against_plain_measures(spark, monkeypatch, sample):
    texts = odd_texts()
    docs = documents(spark, texts).coalesce(1)
    rules = [quality_cascade.Rule(x.name, x.rejects) for x in quality_cascade.RULES]
    got = sorted(map(tuple, quality_cascade.digest(docs).collect()))
    assert got == [(i, *plain_measures(t)[0], plain_measures(t)[0][0] < 50 or 2 * plain_measures(t)[0][4] > plain_measures(t)[0][0], plain_kept(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(quality_cascade, "SAMPLE", sample)
    judged = quality_cascade.Cascade(rules)
    kept = [bool(x) for at in range(0, len(texts), 10) for x in judged(quality_cascade.Texts(pa.array(texts[at : at + 10], pa.string())))]
    assert kept == [plain_kept(t) for t in texts]
    assert quality_cascade.keep(docs).columns == docs.columns and quality_cascade.keep(docs).count() == sum(kept)


def test_reasons_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "A B", 7, "x"), (1, None, 8, "y")], "doc_id long, text string, n_words int, kept string")
    got = sorted((r["n_words"], r["kept"], tuple(r["reasons"])) for r in quality_cascade.judge(docs, reasons=True).collect())
    assert got == [(0, False, ("few words",)), (2, False, ("few words", "word lengths", "capitals"))]
    assert quality_cascade.digest(docs.where("false")).collect() == [] and quality_cascade.keep(docs).columns == docs.columns


def test_order_of_rules():
    rejects = np.zeros((100, 4), bool)
    rejects[:50, 0] = rejects[:40, 1] = rejects[50:60, 2] = True  # what 1 rejects, 0 rejects too
    assert quality_cascade.ordered(rejects, np.array([1.0, 1.0, 1.0, 0.1])) == [0, 2, 3, 1]
    assert quality_cascade.ordered(rejects, np.array([100.0, 1.0, 1.0, 1.0]))[:2] == [1, 2]
    seen = []

    def rule(name, least):
        return quality_cascade.Rule(name, lambda t: seen.append((name, len(t.column))) or t.n_words < least)

    left = quality_cascade.cascade(quality_cascade.Texts(pa.array(["a", "a b", "a b c", "a b c d"])), [rule("x", 3), rule("y", 4), rule("z", 9)])
    assert seen == [("x", 4), ("y", 2), ("z", 1)] and not len(left)


# -- 13 ------------------------------------------------------------------------------------
def plain_words(rows, slip=None):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words.get(form[w], 0)) for w in words)


def groups(found):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in found.collect())


@pytest.mark.parametrize("letters", ["ab", "abcdefghé×"])
def test_variants_against_all_pairs(spark, letters):
    r = random.Random(2)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(4, 9))): r.choice([3, 3, 4, 6, 9, 20, 50, 200]) for _ in range(250)}
    for w in list(words)[:60]:
        k = r.randrange(len(w))
        words[w[:k] + r.choice(letters) + w[k + r.randrange(2) :]] = r.choice([1, 3, 5])
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert groups(spelling_variants.group(table)) == plain_groups(words)


def test_words_and_slips(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["Colour", "COLOR", "Étés-étés", "naïveté", "x" * 70, "flavour1flavor", "中abcdefř"]) for _ in range(40))) for i in range(60)]
    rows += [(None, "Colour colour"), (3, None), (4, ""), (5, "Z" * 300_000 + " " + "z" * 299_999), *[(6, ("zz" * 150_000 + " ") * 2)] * 2, (7, "z" * 299_999), (8, "z" * 299_999)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for slip in (None, 5):
        words = plain_words(rows, slip)
        assert {x["word"]: x["n"] for x in spelling_variants.vocabulary(docs, slip=slip).collect()} == words
        assert groups(spelling_variants.group(spelling_variants.vocabulary(docs, slip=slip))) == plain_groups(words)
    assert spelling_variants.group(spelling_variants.vocabulary(docs.where("false"))).collect() == []


def test_chains_ties_and_accents_of_forms(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "abbbbb": 200, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10}
    got = {x[0]: x for x in groups(spelling_variants.group(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got["aaaaa"] == ("aaaaa", "aaaab", "abbbbb", 3, 1, 6) and got["zzzzz"][1] == "zzzzx" and got["zzzzx"][1] == "" and got["zzzzx"][4] == 2


def test_light_edges_are_few(spark):
    r = random.Random(1)
    words = spark.createDataFrame([("".join(r.choice("abcd") for _ in range(9)), 3) for _ in range(2000)], "word string, n long").distinct()
    most = spelling_variants.light_edges(spelling_variants.named(words)).groupBy("id").count().agg({"count": "max"}).collect()[0][0]
    assert most <= 11


# -- 1 -------------------------------------------------------------------------------------
def test_tiles_of_copies_grow_with_what_is_not_linked(spark):
    from pyspark.sql import functions as F

    from leafwork.llm import ngram_join

    for n, apart in ((2000, 0), (8000, 0), (2000, 40), (8000, 40), (32000, 40)):
        ids = spark.range(n).withColumn("away", F.col("id") >= n - apart)
        dense = ids.select(F.lit(7).cast("long").alias("region"), "id", F.lit(100).alias("n"), F.lit(b"").alias("bits"), F.lit(33).cast("long").alias("wide"), F.when(F.col("away"), F.lit(40)).otherwise(F.lit(5)).cast("long").alias("d"))
        label = ids.where("NOT away").select("id", F.lit(0).cast("long").alias("label"))
        tiles = ngram_join._tiles(dense, label, 512)
        rows = tiles.count()
        assert rows == 0 if not apart else rows <= 3 * n + apart * (3 * (n // 512 + 1) + 3)
        if apart and n == 2000:
            got = {tuple(sorted(x)) for r in tiles.groupBy("region").agg(F.collect_set("id").alias("ids")).collect() for x in ((a, b) for a in r["ids"] for b in r["ids"] if a < b and b >= n - apart)}
            assert len(got) == (n - apart) * apart + apart * (apart - 1) // 2
