"""Small cases for each operator, with plain versions beside them."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.llm import byte_bpe, chat_format, decontaminate, html_extract, language_id, license_scan, ngram_join, pii, url_filter, vector_graph
from leafwork.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, shingles int"


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en" if t and i % 2 else "fr", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


# -- 1 -------------------------------------------------------------------------------------
def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in __import__("re").split("[ \t-\r]+", w) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def plain_components(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [(i, len(s), k) for i, (s, k) in enumerate(zip(sets, label, strict=True))]


def test_join_against_all_pairs(spark):
    base, r = prose(1, 80), random.Random(5)
    texts = [None, "", "  ", "one two", "One TWO", "É b c d e", "é b c d e", base, base, base.upper()]
    for k in range(40):  # near copies of one text, some beyond the threshold, and texts that share a passage
        w = base.split()
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(9))
        texts.append(" ".join(w))
    texts += [prose(100 + k, 20) + " " + prose(2, 60) for k in range(10)] + [prose(200 + k) for k in range(10)]
    got = sorted(tuple(x) for x in ngram_join.join(documents(spark, texts)).collect())
    assert got == plain_components(texts)


def test_join_recurses_to_the_last_pair(spark):
    base = prose(9, 100).split()
    texts = [" ".join(base[k : k + 60]) for k in range(0, 40, 4)] + [" ".join(base[:30] + prose(k, 40).split()) for k in range(8)]
    for rounds in (1, 3):
        assert sorted(tuple(x) for x in ngram_join.join(documents(spark, texts), rounds=rounds).collect()) == plain_components(texts)


@pytest.mark.parametrize(("leaf", "rounds"), [(4, 20), (6, 0)])
def test_large_regions_are_cut(spark, leaf, rounds):
    base, other, r = prose(31, 90).split(), prose(32, 90).split(), random.Random(6)
    texts = [" ".join(base), " ".join(other)]
    for k in range(60):  # two families, many of whose members link with some others only
        w = list((base, other)[k % 2])
        for _ in range(r.randrange(1, 14)):
            w[r.randrange(len(w))] = f"new{r.randrange(40)}"
        texts.append(" ".join(w[: r.randrange(70, 91)]))
    assert sorted(tuple(x) for x in ngram_join.join(documents(spark, texts), leaf=leaf, rounds=rounds).collect()) == plain_components(texts)


def test_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (1, 3, 200, 700, 2500):
        x = np.sort(r.choice(pool, n, replace=False))
        y = np.sort(np.unique(np.concatenate([x[: n * 9 // 10], r.choice(pool, max(1, n // 8))])))
        a, b = ngram_join.parity(x), ngram_join.parity(y)
        size = min(len(a), len(b))
        differ = int(ngram_join._differ(ngram_join._folded(a, size), ngram_join._folded(b, size)))
        assert differ <= len(np.setxor1d(x, y)) and (differ == 0) == (len(np.setxor1d(x, y)) == 0)


def test_join_of_very_long_texts(spark):
    long = prose(77, 60_000)
    texts = [long, long + " end", long[: len(long) // 2], prose(78, 60_000), None]
    got = sorted(tuple(x) for x in ngram_join.join(documents(spark, texts)).collect())
    assert [x[2] for x in got] == [0, 0, 2, 3, 4] and got[0][1] == len(shingles(long))


def test_join_empty_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.join(empty).count() == 0
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "x y z")], "doc_id long, text string")
    got = ngram_join.join(rows).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["n_shingles"] == 2} == {3}
    assert ngram_join.drop_copies(documents(spark, ["a b c d e f", "a b c d e f", None])).count() == 2


def test_copies_of_repeated_and_null_ids(spark):
    a, b, c, d = prose(1), prose(2), prose(3), prose(4)
    near = a.rsplit(" ", 1)[0]
    rows = [(1, a, "x"), (3, near, "x"), (3, b, "y"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (None, None, "x"), (None, None, "x"), (5, d, "x"), (5, d, "x"), (6, d, "x"), (7, b, "x")]
    got = ngram_join.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    want = [(1, a, "x"), (3, b, "y"), (None, c, "x"), (None, None, "x"), (None, None, "x"), (5, d, "x"), (5, d, "x")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# -- 2 -------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies on all pages</div><article><h1>The  title</h1><p>First <b>bo</b>ld &amp; words</p><div class=ad>Buy now</div>
<ul><li>one</li><li>two</li></ul><p>Last&nbsp;words</p><form>Mail <input></form></article><section id="comments"><article>A comment of many words here</article></section><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    costs = {}
    assert html_extract.extract(PAGE, costs) == "The title First bold & words one two Last words"
    assert html_extract.extract(PAGE.replace("<article><h1>", "<div><h1>").replace("</form></article>", "</form></div>"), costs) == "The title First bold & words one two Last words"
    assert html_extract.extract("<p>a < b</p><script>var x='</p>';</script>c<!-- d -->", costs) == "a < b c"
    assert [html_extract.extract(x, costs) for x in (None, "", "<", "plain", "<div", "<p>cut <a href='")] == ["", "", "<", "plain", "", "cut"]
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, "<p>" + "w " * 50_000, "y")], "page_id long, url string, html string, text string")
    got = html_extract.extract_text(rows, html_extract.fit(rows)).orderBy("page_id", "n_chars").collect()
    assert [r["n_chars"] for r in got] == [47, 0, 99_999]
    assert html_extract.extract_text(rows.limit(0), html_extract.fit(rows.limit(0))).count() == 0


def test_a_marked_article_is_whole():
    body, long = "body " * 100, "other " * 300
    for block in (f"<div class=ad>{long}</div>", f"<section id=comments><p>{long}</p></section>", f"<form>{long}</form>", "<figure><img></figure>" * 200):
        page = f"<nav>Menu</nav><article><h1>A B C</h1>{block}<p>{body}</p>{block}<p>one last word</p></article><footer>Foot</footer>"
        assert html_extract.extract(page, {}) == f"A B C {body}one last word"


def test_weights_decide_where_nothing_is_marked(spark):
    r = random.Random(12)
    page = lambda k: f"<html><body><ul><li><a href=x>{prose(k, 5)}</a></li></ul><div class=ad>{prose(k + 1, 30)}</div><article><h1>{prose(k + 2, 4)}</h1><p>{prose(k + 3, 40)}<p>{prose(k + 4, 25)}</article><div>{prose(k + 5, r.randrange(5, 60))}</div></body></html>"
    pages = [page(10 * k) for k in range(30)]
    weights = html_extract.fit(spark.createDataFrame([(i, x) for i, x in enumerate(pages)], "page_id long, html string"))
    for marked in pages:
        bare = marked.replace("article>", "section>").replace(" class=ad", "")
        want = html_extract.extract(marked, weights)
        assert html_extract.extract(bare, weights) == want != html_extract.extract(bare, {})


def test_region_against_all_intervals():
    r = random.Random(2)
    for _ in range(300):
        values = [r.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(r.randrange(12))]
        begin, end = html_extract.best_region(values)
        best = max([0.0, *(sum(values[a:z]) for a in range(len(values)) for z in range(a + 1, len(values) + 1))])
        assert sum(values[begin:end]) == best


# -- 3 -------------------------------------------------------------------------------------
def test_items_in_documents(spark):
    item, short = prose(3, 20), "tiny item here"
    w = item.split()
    texts = [prose(1) + " " + item + " " + prose(2), " ".join(w[:17]), " ".join(w[:15]), "tiny ITEM\there", "a tiny item here", None, "", item + " " + item]
    items = spark.createDataFrame([(7, item, "x"), (8, short, "x"), (9, None, "x"), (9, "", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(documents(spark, texts), items).collect()}
    sets = [shingles(t) for t in texts]
    want = {(d, i) for d, s in enumerate(sets) for i, t in ((7, item), (8, short)) if 4 * len(s & shingles(t)) >= 3 * len(shingles(t)) and s}
    assert got == want and (0, 7) in want and (3, 8) in want and (2, 7) not in want
    assert decontaminate.clean(documents(spark, texts), items).count() == len(texts) - len({d for d, _ in want})
    assert decontaminate.find(documents(spark, texts), items.limit(0)).count() == 0


def test_an_item_id_with_several_texts(spark):
    one, two = prose(11, 40), prose(12, 30)
    texts = [one, "before " + two + " after", one + " " + two, prose(13), " ".join(one.split()[:36])]
    items = spark.createDataFrame([(7, one), (7, two), (7, two)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_item"], r["n_shared"], r["containment"]) for r in decontaminate.find(documents(spark, texts), items).collect()}
    assert got == {0: (36, 36, 1.0), 1: (26, 26, 1.0), 2: (36, 36, 1.0), 4: (36, 32, 32 / 36)}


def test_items_in_very_long_texts(spark):
    item = prose(3, 20)
    texts = [prose(5, 40_000) + " " + item + " " + prose(6, 40_000), prose(7, 60_000), None, item, item]
    items = spark.createDataFrame([(7, item, "x"), (7, item, "y")], "item_id long, text string, hash string")
    assert sorted(r["doc_id"] for r in decontaminate.find(documents(spark, texts).withColumn("hash", F.lit(1)), items).collect()) == [0, 3, 4]
    assert sorted(r["doc_id"] for r in decontaminate.clean(documents(spark, texts), items).collect()) == [1, 2]


# -- 4 -------------------------------------------------------------------------------------
def test_licences(spark):
    s = license_scan.SENTENCES
    mit = f"{s['mit-permission']}\n\n{s['mit-notice']}.\n\n{s['mit-as-is']}."
    wrapped = s["gpl-free"].replace("under the", "under\nthe") + ".\n" + s["gpl-useful"] + ";\n" + s["gpl-merchant"] + ". " + s["gpl-details"] + "."
    texts = [mit, wrapped, "Text. Released under the MIT License.\nReleased under the MIT license", "no licence here", None, "", "the MIT License"]
    got = sorted((r["doc_id"], r["license"], r["n"]) for r in license_scan.scan(documents(spark, texts)).collect())
    assert got == [(0, "MIT", 1), (1, "GPL-3.0-or-later", 1), (2, "MIT", 2)]
    assert license_scan.scan(documents(spark, texts).limit(0)).count() == 0
    assert all(__import__("re").search(license_scan.ANCHORS, x) for x in s.values())


def test_licences_wrapped_or_padded(spark):
    s, edge = license_scan.SENTENCES, "/* " + "*" * 2000 + " "
    cc0, free, rights = s["cc0"], s["unlicense"], s["all-rights"]
    texts = [cc0.replace("public domain", x) for x in ("public\ndomain", "public  domain", "public\u00a0domain")]
    texts += [free.replace("public domain", x) for x in ("public\ndomain", "public\r\n * domain", "PUBLIC\u00a0Domain")]
    texts += [rights.replace(" reserved", x) for x in ("\nreserved", "  reserved", "\u00a0reserved")]
    texts += [edge + s["mit-permission"] + " " + "*" * 2000 + " */", edge + rights]
    want = ["CC0-1.0"] * 3 + ["Unlicense"] * 3 + ["LicenseRef-All-Rights-Reserved"] * 3 + ["MIT", "LicenseRef-All-Rights-Reserved"]
    rows = documents(spark, texts)
    got = sorted((r["doc_id"], r["license"], r["n"]) for r in license_scan.scan(rows).collect())
    assert got == [(i, x, 1) for i, x in enumerate(want)]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert sorted(con.sql(license_scan.oracle()).project("doc_id, license, n").fetchall()) == got


def test_licences_behind_labels(spark):
    s = license_scan.SENTENCES
    texts = [f"License: {s['mit-short']}.", f"1. {s['bsd-source']}.\n(b) {s['cc0']}", f"Terms of use:  {s['gpl3-short']}; more", "Note: no licence", "x " * 400_000 + f"\nLicense: {s['mit-short']}."]
    rows = documents(spark, texts)
    got = sorted((r["doc_id"], r["license"], r["n"]) for r in license_scan.scan(rows).collect())
    assert got == [(0, "MIT", 1), (1, "CC0-1.0", 1), (2, "GPL-3.0-only", 1), (4, "MIT", 1)]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert sorted(con.sql(license_scan.oracle()).project("doc_id, license, n").fetchall()) == got


# -- 5 -------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = ["http://A.Net/x", "https://www.example.net/en/1", "http://example.com/de/", "http://x.org/fr/?a=b", "http://x.org/frost", "ftp://net", "nothing", None, "http://notexample.com/de/", "http://net/", "x://casino-win.example.com/en/9"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(rows).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("example.com/de/", "block")
    assert got[3] == ("x.org", "/fr/", "org/fr/", "allow") and got[4][2] is None and got[5] == ("net", "", None, "allow")
    assert got[6][:2] == got[7][:2] == ("", "") and got[8][2] is None and got[9][2] == "net/" and got[10][3] == "block"
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_mined_rules_against_counts(spark):
    r = random.Random(3)
    rows = [([f"a={r.randrange(3)}", f"b={r.randrange(3)}"], None) for _ in range(300)]
    rows = [(t, "block" if t == ["a=1", "b=2"] or r.random() < 0.1 else "allow") for t, _ in rows]
    found = {tuple(x["antecedent"]): x["confidence"] for x in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.8).collect()}
    hit = [v for t, v in rows if t == ["a=1", "b=2"]]
    assert list(found) == [("a=1", "b=2")] and found["a=1", "b=2"] == pytest.approx(hit.count("block") / len(hit))


def test_seed_words_without_a_hyphen(spark):
    hosts = ["casino.example.com", "www.porn.org", "spam.example.com", "my-ads.example.com", "www.spamalot.example.com", "casinos.example.com", "www.example.com"]
    rows = spark.createDataFrame([(i, f"http://{h}/en/{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(rows).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"] * 3


def test_mined_rules_against_all_combinations(spark):
    from itertools import combinations

    r, rows = random.Random(8), []
    for _ in range(200):
        a, b, c = r.randrange(3), r.randrange(3), r.randrange(4)
        verdict = "block" if c == 3 or (a, b) == (1, 2) and r.random() < 0.9 else "allow"
        rows.append((sorted({f"a={a}", f"again={a}", f"b={b}", f"c={c}", "all=1"}), verdict))
    found = {tuple(x["antecedent"]): x["confidence"] for x in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8).collect()}
    tokens, good = sorted({t for ts, _ in rows for t in ts}), {}
    for k in range(1, 6):
        for rule in combinations(tokens, k):
            hit = [v for ts, v in rows if set(rule) <= set(ts)]
            bad = hit.count("block")
            if bad >= 0.02 * len(rows) and bad >= 0.8 * len(hit) and not any(set(g) < set(rule) and good[g] >= bad / len(hit) for g in good):
                good[rule] = bad / len(hit)
    assert found == pytest.approx(good) and len(good) > 3


def test_all_keys_segments_and_levels_are_tokens(spark):
    plain = [f"http://a.b.c.d.example.com/x/y/z{i}?k1=1&k2=2&k3=3" for i in range(20)]
    labelled = [(u, "allow") for u in plain] + [(f"{u}&zz=4", "block") for u in plain] + [(u.replace("/z", "/bad/z"), "block") for u in plain] + [(u.replace("a.b", "a.bad.b"), "block") for u in plain]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(labelled, "url string, verdict string"), rules=()).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == [v for _, v in labelled]
    host, path = url_filter.parse(F.col("url"))
    tokens = set(pages.where("page_id = 0").select(url_filter.tokens(F.col("url"), host, path)).first()[0])
    assert {"host6=a.b.c.d.example.com", "host5=b.c.d.example.com", "host1=com", "seg1=x", "seg3=z#", "key=k3"} <= tokens


def test_labels_empty_repeated_and_with_clashing_names(spark):
    urls = [f"http://shop{i}.example.com/a" for i in range(20)] + ["http://casino.example.com/a", "http://casino.example.com/a"]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, listed string").drop("listed")
    bare = [r["verdict"] for r in url_filter.judge(pages).orderBy("page_id").collect()]
    none = spark.createDataFrame([], "url string, verdict string, host string, path string")
    assert bare == [r["verdict"] for r in url_filter.judge(pages, none).orderBy("page_id").collect()] == ["allow"] * 20 + ["block"] * 2
    labels = spark.createDataFrame([(u, "block" if "shop1" in u else "allow", "h", "p") for u in urls[:20]] * 2, "url string, verdict string, host string, path string")
    got = url_filter.judge(pages, labels).orderBy("page_id").collect()
    assert len(got) == 22 and got[20]["verdict"] == got[21]["verdict"] == "block" and got[20]["host"] == "casino.example.com"


# -- 6 -------------------------------------------------------------------------------------
def test_bpe_against_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    with open(vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ours, theirs = byte_bpe.coder(vocabulary()), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    parts = ["'", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "Zed", "é", "中文", "٣", "12", "!", "...", "\U0001f600", "\u0301", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)] + ["", "a" * 3000, "!" * 3000, " " * 500, "it's 'tis we're"]
    for t in texts:
        assert ours.encode_one(t) == theirs.encode_ordinary(t), t
    rows = documents(spark, [None, "", "It's  text\n\n", "é" * 5000]).withColumn("ids", F.lit(1))
    got = {x["doc_id"]: x for x in byte_bpe.decode(byte_bpe.encode(rows, vocabulary()), vocabulary()).collect()}
    assert bytes(got[2]["decoded"]).decode() == "It's  text\n\n" and got[0]["ids"] == got[1]["ids"] == [] and got[2]["offsets"][-1] == 12
    told = {x["doc_id"]: x for x in byte_bpe.digest(rows, vocabulary()).collect()}
    ids = theirs.encode_ordinary("It's  text\n\n")
    assert told[2]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and told[2]["n_tokens"] == len(ids)
    assert byte_bpe.digest(rows.limit(0), vocabulary()).count() == 0


# -- 7 -------------------------------------------------------------------------------------
def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    told = language_id.predict(docs.where(language_id.held_out()), profiles)
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    assert told.where("score < 0 or score > 1").count() == 0
    odd = language_id.predict(documents(spark, [None, "", "123 !?", "x", "Ж"]).withColumn("score", F.lit(1)), profiles).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False, False]
    assert language_id.predict(docs.limit(3), {}).where("lang_pred = 'und'").count() == 3
    assert language_id.learn(docs.limit(0)) == {}


def plain_grams(text):
    """Letters alone, in pairs and in threes; what isn't a letter is one blank, at both ends too."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    padded = " " + " ".join(low.split()) + " "
    return [g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " "]


def test_languages_against_plain_profiles(spark):
    from collections import Counter

    r = random.Random(4)
    alphabets = {"aa": "abcde fg", "bb": "defgh ij", "cc": "aeiou xy", "dd": "abcdj xz"}
    texts, langs = [], []
    for k in range(160):
        lang = sorted(alphabets)[k % 4]
        texts.append("".join(r.choice(alphabets[lang]) for _ in range(r.randrange(1, 300))) + r.choice(["", "!", " 12 ", "A"]))
        langs.append(lang)
    rows = spark.createDataFrame([(i, t, x, "s") for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, lang_pred string")
    size = 60
    profiles = language_id.learn(rows, size=size)
    # the same codes, written as strings
    told = lambda code: tuple((int(code) >> s) & 255 for s in (16, 8, 0)[-(int(code) >> 24) :])
    symbol = lambda g: tuple(int(language_id.symbols()[ord(c)]) if c != " " else 0 for c in g)
    plain = {}
    for lang in alphabets:
        counts = Counter(symbol(g) for t, x in zip(texts, langs, strict=True) if x == lang and any(map(str.isalpha, t)) for g in plain_grams(t))
        ranked = sorted(counts.items(), key=lambda kv: (-kv[1], len(kv[0]), kv[0]))[:size]
        plain[lang] = [g for g, _ in ranked]
        assert [told(c) for c in profiles[lang]] == plain[lang]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(rows, profiles, size=size).collect()}
    for i, t in enumerate(texts):
        if not any(map(str.isalpha, t)):
            assert got[i] == ("und", 0.0)
            continue
        counts = Counter(map(symbol, plain_grams(t)))
        own = [g for g, _ in sorted(counts.items(), key=lambda kv: (-kv[1], len(kv[0]), kv[0]))[:size]]
        far = {x: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)) for x, p in plain.items()}
        best = min(sorted(far), key=far.get)
        assert got[i] == (best, pytest.approx(1 - far[best] / (size * len(own))))


def test_languages_of_long_and_repeated_texts_and_ties(spark):
    rows = spark.createDataFrame([(1, "ab " * 200_000, "x"), (1, "ab " * 200_000, "x"), (2, "ab", "x"), (3, "cd ef", "y"), (4, "cd ef", "z")], "doc_id long, text string, lang string")
    profiles = language_id.learn(rows)
    got = [(r["lang_pred"], r["score"]) for r in language_id.predict(rows, profiles).orderBy("doc_id").collect()]
    assert got[0] == got[1] and [x for x, _ in got] == ["x", "x", "x", "y", "y"]  # equal profiles: the first by name
    assert language_id.predict(rows.limit(0), profiles).count() == 0


def test_out_of_place_distance():
    a, b = {"x": np.array([5, 6, 7], np.uint32)}, np.array([6, 6, 5, 9], np.uint32)
    # ranks in the text: 6, 5, 9; in the profile: 1, 0, absent (3)
    assert language_id.Ranker(a, 3).predict(b) == ("x", pytest.approx(1 - (1 + 1 + 3) / 9))


# -- 8 -------------------------------------------------------------------------------------
def test_personal_data(spark):
    import re

    text = "Mail a.b@ex-a.co.uk, c@d or @x.com; card 4111 1111 1111 1111 or 4111-1111-1111-1112; ip 1.2.3.4 999.1.1.1 1.2.3.4.5; tel +49 (30) 1234-567 +1; IBAN DE89 3704 0044 0532 0130 00; é x@y.zé"
    found = pii.find(text)
    kinds = {k: [text[s:e] for kind, s, e, _ in found if kind == k] for k in pii.FINDERS}
    assert kinds["email"] == ["a.b@ex-a.co.uk", "x@y.z"] and kinds["card"] == ["4111 1111 1111 1111"]
    assert kinds["ip"] == ["1.2.3.4", "1.2.3.4"] and kinds["phone"] == ["+49 (30) 1234-567"] and kinds["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert "@" not in pii.mask(text, found).replace("c@d", "").replace("@x.com", "")
    r = random.Random(2)
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        t = "".join(r.choice(["a", "@", ".", "-", "1", "22", "255", "256", " ", "+", "(", "é", "b.c", "@x.y", "4111111111111111", "0."]) for _ in range(r.randrange(25)))
        for kind, pattern in base.items():
            want = [m.span() for m in re.finditer(pattern, t)]
            if kind == "ip":
                want = [s for s in want if all(int(p) <= 255 for p in t[slice(*s)].split("."))]
            if kind == "card":
                want = [s for s in want if 13 <= sum(c.isdigit() for c in t[slice(*s)]) <= 19 and pii.luhn("".join(filter(str.isdigit, t[slice(*s)])))]
            if kind == "phone":
                want = [s for s in want if 9 <= sum(c.isdigit() for c in t[slice(*s)]) <= 15]
            assert list(pii.FINDERS[kind](t)) == want, (kind, t)
    rows = documents(spark, [None, "", text, text, "9" * 200_000, "a" * 200_000 + "@"])
    got = pii.digest(rows).orderBy("doc_id").collect()
    assert [x["n_email"] for x in got] == [0, 0, 2, 2, 0, 0] and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.mask_text(rows).columns == rows.columns and pii.find_spans(rows.limit(0)).count() == 0


def test_secrets_and_scores(spark):
    hexa, key = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "AKIA" + "ABCDEFGH12345678"
    texts = [f'our token = "{hexa}" here', f"aws {key}.", "password: correcthorse", "password: Tr0ub4dor&3x", "the token was lost", "api_key='zzzzzzzzzzzz'", f"-----BEGIN RSA PRIVATE KEY-----\n{hexa}", None]
    found = [[t[s:e] for k, s, e, _ in pii.find(t) if k == "secret"] for t in texts]
    assert found == [[hexa], [key], [], ["Tr0ub4dor&3x"], [], [], ["-----BEGIN RSA PRIVATE KEY-----"], []]
    got = pii.digest(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_spans"] for r in got] == [1, 1, 0, 1, 0, 0, 1, 0] and got[0]["score"] == pytest.approx(0.8) and got[4]["score"] == 0.0


# -- 9 -------------------------------------------------------------------------------------
def test_neighbours(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(600, 16)) + rng.normal(size=(6, 16)).repeat(100, 0) * 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(600 + k, rows_) for k, rows_ in enumerate([[1.0] * 16] * 40)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (0, [float(x) for x in data[0]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = {}
    for r in vector_graph.search(table, table.where("vec_id % 20 = 0"), shard=200).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, all_ = np.arange(640), np.array([r[1] for r in rows[:640]])
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    hits = total = 0
    for q, found in got.items():
        sims = unit @ unit[q]
        sims[q] = -9
        want = ids[np.lexsort((ids, -np.round(sims, 9)))[:5]]
        hits, total = hits + len(set(want) & {v for v, _ in found.values()}), total + 5
        if q >= 600:
            assert [found[k][0] for k in range(1, 6)] == [i for i in range(600, 640) if i != q][:5]
        assert [found[k][1] for k in range(1, 6)] == pytest.approx([sims[found[k][0]] for k in range(1, 6)])
    assert len(got) == 32 and hits >= 0.95 * total
    one = table.where("vec_id = 3")
    assert vector_graph.search(one, one).count() == 0 and vector_graph.search(table.limit(0), table.limit(0)).count() == 0


# -- 10 ------------------------------------------------------------------------------------
def test_chat_windows(spark):
    r = random.Random(7)
    rows = [(1, 0, "system", "be kind \\<turn"), *((1, t, ["user", "assistant"][t % 2 == 0], "</turn> \\ " + "w " * r.randrange(400)) for t in range(1, 30))]
    rows += [(2, 0, "user", "x" * 9000), (2, 1, "assistant", None), (2, 1, None, "tie"), (None, 0, "assistant", "é"), (None, 0, "assistant", "é")]
    turns = spark.createDataFrame([(*x, "f") for x in rows], "conv_id long, turn long, role string, text string, window string")
    formed = chat_format.windows(turns, budget=600, history_tokens=100).collect()
    plain = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or "", x[3] or ""))
    for conv in (1, 2, None):
        own = [x for x in plain if x[0] == conv]
        windows = sorted((x for x in formed if x["conv_id"] == conv), key=lambda x: x["window"])
        seen, learnt = [], []
        for w in windows:
            first = next(s["turn"] for s in w["segments"] if not s["repeated"])
            if conv == 1:
                assert w["segments"][0]["turn"] == 1
            assert sum(s["repeated"] for s in w["segments"]) <= 3
            tokens = sum((s["stop"] - s["start"]) // 4 + 5 for s in w["segments"])
            assert tokens <= 600 + 100 or len([s for s in w["segments"] if not s["repeated"]]) == 1
            for s in w["segments"]:
                body = w["formatted"][s["start"] : s["stop"]].replace("\\\\", "\0").replace("\\<", "<").replace("\0", "\\")
                assert body == (own[s["turn"] - 1][3] or "") and (s["repeated"] == (s["turn"] < first))
                if not s["repeated"]:
                    seen.append(s["turn"])
                if s["loss"]:
                    learnt.append(body)
        assert seen == list(range(1, len(own) + 1)) and learnt == [x[3] or "" for x in own if x[2] == "assistant"]
    told = {x["conv_id"]: x for x in chat_format.digest(chat_format.windows(turns)).collect()}
    text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in plain if x[0] == 1)
    assert told[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and told[1]["n_turns"] == 30
    assert chat_format.digest(chat_format.windows(turns.limit(0))).count() == 0
