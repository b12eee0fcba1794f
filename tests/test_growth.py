"""Steps that once broke or slowed down as tables grew."""

import json
import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from leafwork.functions import rolls
from leafwork.functions import text as T
from leafwork.llm import spelling_variants
from leafwork.operators import frames, gridless, grids, ordering, pixels, segments, sizes
from leafwork.plans import journal_queries
from leafwork.plans.registry import QUERIES
from leafwork.sources import layout


def test_journal_of_more_pages_than_an_int_has_sort_keys(spark):
    n = 21480
    text = F.col("id").cast("string")
    pages = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.lit('B"}').alias("name"), text.alias("title"), F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("html"))
    (made,) = frames.journals(pages).collect()
    entry = json.loads(made["entry"])
    assert entry["name"] == 'B"}' and [p["sort"] for p in entry["pages"]] == [(k + 1) * 100000 for k in range(n)]
    assert list(entry) == ["name", "pages", "folder", "sort", "ownership", "_stats"]
    assert json.loads(made["macro"].split("\n")[0][len("const data = ") : -1]) == {k: v for k, v in entry.items() if k != "_stats"}
    assert made["preview"].startswith("<article><h1>0</h1><p>0</p></article><article><h1>1</h1>") and made["preview"].count("<article>") == n


def test_stat_lines_are_read_by_many_tasks_and_matched_few_times(spark, sf_dir):
    made = QUERIES["f15_f16_a10_stat_lines"](spark, sf_dir)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.where("tab is not null").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") < 10


@pytest.mark.parametrize("name", ["f10_f14_j18_checks", "f19_runs_html", "f20_f21_j21_render"])
def test_rows_of_a_small_file_are_written_by_many_tasks(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_without_an_opener_are_not_read_as_words(monkeypatch):
    monkeypatch.setattr(rolls, "Words", None)
    assert rolls.find_rolls("almond antique rose, teapot") == []


def test_gridless_tables_grow_with_their_rows(monkeypatch):
    calls, of = [], grids.anchors_of
    monkeypatch.setattr(grids, "anchors_of", lambda rows: calls.append(len(rows)) or of(rows))
    y = [14.0 * k for k in range(3000)]
    block = [{"spans": [{"text": f"w{k}", "font": "", "size": 10.0, "flags": 0, "x0": 54 + 90.0 * c, "y0": v, "x1": 114 + 90.0 * c, "y1": v + 10} for c in range(5)], "bbox": (54.0, v, 474.0, v + 10)} for k, v in enumerate(y)]
    ((_, table),), used = grids.text_tables([block], 10.0, 612.0)
    assert len(table["rows"]) == len(used) == len(y) and table["rows"][7] == ["w7"] * 5
    assert calls == [len(y)]  # once for a table, not for each of its rows


def test_columns_of_a_growing_group_are_those_of_all_its_rows():
    r = random.Random(3)
    cell = lambda x: grids.Cell((x, 0.0, x + 5, 10.0), "a", False)
    for _ in range(200):
        rows = [grids.Row([cell(r.choice([r.uniform(0, 120), 8.0 * r.randint(0, 15)])) for _ in range(r.randint(1, 4))]) for _ in range(12)]
        columns = grids.Columns(rows[0])
        for row in rows[1:]:
            columns.add(row)
        want = grids.anchors_of(rows)
        assert np.allclose([s / n for s, n in zip(columns.sum, columns.n, strict=True)], want)
        for x in range(0, 130, 3):
            assert columns.holds(x + 0.3) == bool((abs(want - x - 0.3) <= grids.ALIGNED).any())


def test_visible_parts_read_only_rows_that_an_image_reaches(spark):
    images = spark.createDataFrame([(1, 0, 1, 0.0, 3.0, 30.0, 9.0), (1, 0, 2, 0.0, 60.0, 9.0, 900.0), (2, 0, 1, 0.0, 72.0, 30.0, 99.0), (3, 0, 1, 9.0, 0.0, 9.0, 9.0)], "book_id long, page_no int, item_no int, x0 double, y0 double, x1 double, y1 double")
    keys, page = ["book_id", "page_no"], (0.0, 0.0, 612.0, 792.0)
    rows = pixels.reached(images, page, 48, keys)
    assert sorted(r.row_no for r in rows.collect()) == list(range(2, 48)) and rows.where("book_id > 1").isEmpty()
    blank = rows.withColumn("values", F.expr("if(row_no = 4, array(0, 0, 11, 12, 0), array(1, 2))"))
    (seen,) = pixels.visible(images, blank, page, keys).collect()
    assert (seen.item_no, seen.x0, seen.y0, seen.x1, seen.y1) == (1, 2.0, 5.0, 7.0, 8.5)


def test_nearest_anchor_pairs_no_cell_with_all_anchors(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 5), k, r.choice([None, r.uniform(0, 300), float(r.randint(0, 40) * 8)]) if k % 9 == 0 else r.uniform(0, 300)) for k in range(400)]
    cells = spark.createDataFrame(rows, "book_id long, item_no int, x0 double")
    found = ordering.anchors(cells.where("x0 is not null"), ["book_id"])
    means = {}
    for a in found.collect():
        means.setdefault(a.book_id, []).append((a.anchor, a.ax))
    near = ordering.nearest_anchor(cells, found, ["book_id"], "item_no")
    want = {(b, k): min((0.0 if x is None else abs(x - ax), n) for n, ax in means[b])[1] for b, k, x in rows}
    assert {(x.book_id, x.item_no): x.anchor for x in near.collect()} == want and near.count() == len(want)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("of", [partial(layout.book_lines, together=True), layout.page_rects])
def test_tasks_follow_the_size_of_a_table(of, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(layout, "TASK_BYTES", 500)
    few = of(spark, sf_dir).rdd.getNumPartitions()
    monkeypatch.setattr(layout, "TASK_BYTES", 250)
    assert 8 < few < of(spark, sf_dir).rdd.getNumPartitions()


def test_words_and_their_edges_are_never_broadcast(spark, monkeypatch):
    plans, of = [], spelling_variants.saved
    monkeypatch.setattr(spelling_variants, "saved", lambda df, name: plans.append(df) or of(df, name))
    words = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("zzzzz", 3)], "word string, n long")
    plans.append(spelling_variants.group(words))
    told = [df._jdf.queryExecution().optimizedPlan().toString() for df in plans]
    joins = [x for plan in told for x in plan.split("\n") if "Join " in x]
    assert len(joins) >= 6 and all("strategy=merge" in x for x in joins)


def test_line_kinds_lay_out_the_words_once_and_shuffle_none(spark, sf_dir):
    made = QUERIES["j2_p17_line_kinds"](spark, sf_dir)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("Join ") == 3  # tables of a book and size, none of words
    shuffled = QUERIES["a1_a13_dominant_size"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shuffled


@pytest.mark.parametrize("most", [40, 1_000_000])
def test_sizes_of_whole_lines_are_those_of_their_spans(spark, monkeypatch, most):
    r = random.Random(8)
    blank = ["", " ", "\u2009\u3000", "a", "\u00a0b c\t", "\x1cd", "\U0001f600e"]
    rows = [(b, k, ";".join(f"{r.choice(blank)},{r.choice([9.75, 10.0, 10.2, 12.25, 14.0])},{r.randint(0, 3)}" for _ in range(r.randint(1, 7)))) for b in range(3) for k in range(120)]
    lines = spark.createDataFrame(rows, "book_id long, line_no int, text string").repartition(2)

    def spans_of(batch):
        spans = [(k, *x.split(",")) for k, t in enumerate(batch.column("text").to_pylist()) for x in t.split(";")]
        line, text, size, bold = zip(*spans, strict=True)
        return np.array(line), pa.array(text), np.array(size, float), np.array(bold) != "0"

    monkeypatch.setattr(sizes, "SLICE_BYTES", most)
    got = sizes.sized_lines(lines, ["book_id", "line_no"], spans_of)
    flat = lines.select("book_id", "line_no", F.posexplode(F.split("text", ";")).alias("span_no", "s")).select("book_id", "line_no", "span_no", F.split("s", ",").alias("s"))
    flat = flat.select("book_id", "line_no", "span_no", F.col("s")[0].alias("text"), F.col("s")[1].cast("double").alias("size"), (F.col("s")[2] != "0").alias("bold"))
    want = sizes.dominant_sizes(flat, ["book_id", "line_no"])
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and 300 < got.count() < 360
    assert sizes.sized_lines(lines.where("false"), ["book_id"], spans_of).collect() == []


def test_strip_is_what_the_pattern_was(spark):
    r = random.Random(4)
    odd = [chr(k) for k in range(0x3100) if not chr(k).isalnum()] + ["\ufeff", "\ufffd", "\U0001f600"]
    texts = [(c + "a" + c + "b" + c,) for c in map(chr, range(1, 0xD800))] + [("".join(r.choice(" \t\n\r\x0b\x85\u2028\u3000xé") if r.random() < 0.7 else r.choice(odd) for _ in range(r.randint(0, 9))),) for _ in range(3000)]
    rows = spark.createDataFrame([*texts, (None,)], "t string")
    assert rows.where(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).collect() == []
    assert "regexp" not in rows.select(T.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def drawn_page(r: random.Random, tidy: bool) -> list[list[dict]]:
    """Blocks of lines in columns: tidy ones seldom leave one out, others overlap, jump and stand side by side."""
    word = lambda: r.choice(["a", "b c", "12", "+3", "1D6", "x" * 31, "y" * 161, "FOR", "50", "\xad", " ", "a\xadb", "t\tu", "\xa0v ", "\x1cw", "\u3000", "\u00e9"])
    stat = lambda k: r.choice(["FOR", "CON", "DES"]) if k % 2 == 0 else r.choice(["50", "80", "+3"])
    blocks = []
    for _ in range(1 if tidy else r.choice([1, 2, 3])):
        left, y, lines = r.choice([54.0, 120.0]), r.choice([40.0, 47.0]), []
        for _ in range(r.randint(1, 14)):
            spans, stats, columns = [], r.random() < 0.2, r.choice([1, 2, 4, 5, 5, 16])
            if columns == 1 and r.random() < 0.7:
                columns, below = 5, r.randint(0, 4)
            else:
                below = None
            for k in range(columns):
                if (below is not None and k != below) or r.random() < (0.03 if tidy else 0.15):
                    continue
                x = left + (60.0 if columns < 9 else 20.0) * (k if tidy or r.random() < 0.9 else r.randint(0, 5)) + (r.choice([0, 0, 0, 2, 5.5]) if tidy else r.choice([0, 4, 7.5, 8, 8.5]))
                top = y if tidy else y + r.choice([0, 0, 3.5, 6])
                wide, high = r.choice([10.0, 30.0, 45.0, 3.0 if tidy else 52.0]), 10.0 if tidy else r.choice([10.0, 10.0, 0.5, 30.0])
                wide = -5.0 if not tidy and r.random() < 0.01 else wide
                text = stat(k) if stats else word() if not tidy or r.random() < 0.2 else r.choice(["a", "12", "b c"])
                spans.append({"text": text, "font": "", "size": r.choice([10.0, 0.0, 14.25]), "flags": 16 if r.random() < (0.2 if lines else 0.9) else 0, "x0": x, "y0": top, "x1": x + wide, "y1": top + high})
            if spans:
                lines.append({"spans": spans})
            y += r.choice([11.0, 12.0, 14.0, 14.0, 26.5, 40.0] if tidy else [0.0, 3.0, 12.0, 14.0, 26.0, 26.5, -20.0])
        if lines:
            blocks.append(lines)
    return blocks


@pytest.mark.parametrize(("tidy", "most"), [(True, gridless._MOST_BELOW), (True, 0), (False, gridless._MOST_BELOW)])
def test_tables_of_many_pages_are_those_of_each(monkeypatch, tidy, most):
    r, apart, tables, of = random.Random(11), [], 0, gridless.table_of
    monkeypatch.setattr(gridless, "table_of", lambda *a: apart.append(made := of(*a)) or made)
    monkeypatch.setattr(gridless, "_MOST_BELOW", most)
    for _ in range(250):
        pages = [p for _ in range(r.randint(1, 5)) if (p := drawn_page(r, tidy))]
        where = [(p, b, k) for p, blocks in enumerate(pages) for b, lines in enumerate(blocks) for k in range(len(lines))]
        block = np.cumsum([k == 0 for _, _, k in where]) - 1
        spans = [(p, block[n], n, s["text"], s["x0"], s["y0"], s["x1"], s["y1"], s["size"], s["flags"] > 0) for n, (p, b, k) in enumerate(where) for s in pages[p][b][k]["spans"]]
        if not spans:
            continue
        found, used = gridless.page_tables(gridless.Spans(*(pa.array(c, pa.string()) if n == 3 else np.array(c) for n, c in enumerate(zip(*spans, strict=True)))), 10.0, 612.0)
        for p, blocks in enumerate(pages):
            want = grids.text_tables(blocks, 10.0, 612.0)
            assert ([f[1:] for f in found if f[0] == p], {where[n][1:] for n in used if where[n][0] == p}) == want
            tables += len(want[0])
    assert tables > 300 and (not tidy or not most or tables - sum(t is not None for t in apart) > 0.6 * tables)


def test_columns_that_drift_or_hold_two_cells_of_a_row_are_told_one_at_a_time():
    span = lambda x, y, wide=9.0: {"text": f"w{x:.0f}", "font": "", "size": 1.0, "flags": 0, "x0": x, "y0": y, "x1": x + wide, "y1": y + 10}
    drift = [[span(x + 7.0 * k, 40.0 + 12 * k) for x in (54.0, 300.0)] for k in range(8)]
    double = [[span(54.0, 40.0 + 12 * k, 1.0), span(61.5, 40.0 + 12 * k), span(200.0, 40.0 + 12 * k)] for k in range(4)]
    for lines in (drift, double):
        want, used = grids.text_tables([[{"spans": own} for own in lines]], 10.0, 612.0)
        rows = [(0, 0, k, s["text"], s["x0"], s["y0"], s["x1"], s["y1"], s["size"], False) for k, own in enumerate(lines) for s in own]
        found, numbers = gridless.page_tables(gridless.Spans(*(pa.array(c, pa.string()) if n == 3 else np.array(c) for n, c in enumerate(zip(*rows, strict=True)))), 10.0, 612.0)
        assert [f[1:] for f in found] == want and {(0, n) for n in numbers} == used and want
    assert len(want[0][1]["rows"][0]) == 2  # two cells in the first column


def test_blanks_of_texts_are_those_of_python():
    assert {c for c in map(chr, range(0xD800)) if c.isspace()} == set(T.BLANKS + "\x1c\x1d\x1e\x1f")


@pytest.mark.parametrize("most", [50, 1_000_000])
def test_gridless_tables_of_documents_shuffle_no_words(spark, tmp_path, monkeypatch, most):
    r = random.Random(6)
    words = ["a", "bb", "FOR", "50", "CON", "60", "", "\t", "x" * 40, '"q\\', "\u00e9", "\x01", "c\xadc", "DES", "70", "STR", "80"]
    texts = ["\n".join(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 8, 10, 11, 26]))) for _ in range(r.randint(0, 6))) for _ in range(60)]
    docs = [*enumerate(texts), (-7, texts[3]), (None, "a b c d e f g"), (None, None), (70, None), (71, ""), (72, texts[4]), (72, texts[4])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(journal_queries, "_SLICE_BYTES", most)
    made = QUERIES["w7_w10_j14_text_tables"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == plan.count("Repartition") == 1 and plan.index("Generate") < plan.index("Repartition")  # texts are dealt, then split
    got = {}
    for x in made.collect():
        got.setdefault((x.book_id, x.page_no), []).append((x.table_no, x.used_lines, x.rows))
    pages, want = {}, {}
    for doc, text in docs:
        key = (None, None) if doc is None else (int(doc / 10), doc - 10 * int(doc / 10))
        pages.setdefault(key, []).extend((k, n, t) for k, line in enumerate(text.split("\n") if text is not None else ()) for n, t in enumerate(line.split(" ")))
    for key, spans in pages.items():
        block = []
        for k, n in sorted({(k, n // 5) for k, n, _ in spans}):
            y = 14.0 * len(block) + 40.0 * k
            block.append({"spans": [{"text": t, "font": "", "size": 10.0, "flags": 0, "x0": 54 + 90.0 * (m % 5), "y0": y, "x1": 114 + 90.0 * (m % 5), "y1": y + 10} for j, m, t in sorted(spans) if (j, m // 5) == (k, n)]})
        found, used = grids.text_tables([block], 10.0, 612.0)
        if found:
            want[key] = [(n, len(used), json.dumps(t["rows"], ensure_ascii=False)) for n, (_, t) in enumerate(found)]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 30


def test_batches_are_cut_where_groups_begin():
    batch = pa.record_batch({"k": [1, 1, 2, 3, 3, 4], "text": ["aa", "aa", "aaaaaaaaa", None, "a", "a"]})
    cut = lambda most: [b.column("k").to_pylist() for b in segments.group_slices(batch, ["k"], "text", most)]
    assert cut(5) == [[1, 1, 2], [3, 3, 4]] and cut(100) == [[1, 1, 2, 3, 3, 4]] and cut(1) == [[1, 1], [2], [3, 3], [4]]
