"""Paragraphs and streams by window expressions against the functions of one block and one document."""

import random

from leafwork.functions.text import half_points
from leafwork.operators import flow
from leafwork.operators import journal as J
from leafwork.operators.paragraphs import paragraphs, plain
from pyspark.sql import functions as F

_TEXTS = ["Um texto que", "segue e con-", "tinua aqui.", "• item", "1) coisa", "Nome: valor", "Vida: 12,", "Fim.", "a", "É", "FOR 10 CON 20 DES 30 POD 40", " ", "so\xadft", "(aberto (", "Capital depois", "x - ", "título"]


def drawn(seed):
    r, y, out = random.Random(seed), 0.0, []
    for _ in range(r.randrange(1, 12)):
        x, size = r.choice([50.0, 50.0, 50.0, 62.0, 90.0]), r.choice([10.0, 10.0, 10.25, 14.0, 18.25])
        for k in range(r.choice([1, 1, 1, 2, 3])):  # fragments at about one height
            wide = r.choice([60.0, 200.0, 300.0])
            top = y + r.choice([0.0, 0.0, 3.0]) * (k > 0)
            out.append((r.choice(_TEXTS), size, r.random() < 0.4, x, top, x + wide, top + size))
            x += wide + r.choice([-0.5, 2.0, 5.0])
        y += size + r.choice([1.0, 2.0, 9.0])
    return out


def test_paragraphs_against_one_block_at_a_time(spark):
    drawn_ = {n: drawn(n) for n in range(250)}
    rows = [(n, i, *ln) for n, own in drawn_.items() for i, ln in enumerate(own)]
    lines = spark.createDataFrame(rows, "block int, line_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
    alone = lines.groupBy("block", "y0", "size").agg(F.count("*").alias("n"))  # fragments of one size and weight make lines of runs that look alike
    assert alone.count() > 250
    joined = flow.same_row(lines, ["block"], "line_no")
    from leafwork.operators.paragraphs import rejoin

    want, got = {}, {}
    for n, own in drawn_.items():
        frags = [{"spans": [i], "bbox": ln[3:]} for i, ln in enumerate(own)]
        want[n] = [(g["spans"], g["bbox"]) for g in rejoin(frags)]
    for r in joined.orderBy("block", "line_no").collect():
        first = r["line_no"]
        got.setdefault(r["block"], []).append(([first + k for k in range(len(r["parts"]))], (r["x0"], r["y0"], r["x1"], r["y1"])))
    assert got == want
    single = lines.where("line_no >= 0")
    read = single.withColumn("size", half_points(F.col("size")))
    level = F.when(F.col("size") == 18.0, 1).when(F.col("size") == 14.0, 2)
    made = {}
    spread = read.withColumn("y0", F.col("y0") + 40.0 * F.col("line_no")).withColumn("y1", F.col("y1") + 40.0 * F.col("line_no"))  # one fragment a line
    for r in flow.paragraphs(spread, ["block"], "line_no", F.lit(10.0), level).orderBy("block", "ord").collect():
        made.setdefault(r["block"], []).append((r["kind"], r["text"]) if r["kind"] != "table" else "table")
    told = {}
    for n, own in drawn_.items():
        block = []
        for i, (text, size, bold, x0, y0, x1, y1) in enumerate(own):
            size = round(size * 2) / 2
            span = {"text": text, "font": "", "size": size, "flags": 16 * bold, "x0": x0, "y0": y0 + 40 * i, "x1": x1, "y1": y1 + 40 * i}
            block.append({"spans": [span], "bbox": (x0, y0 + 40 * i, x1, y1 + 40 * i)})
        if blocks := paragraphs(block, 10.0, {18.0: 1, 14.0: 2}):
            told[n] = ["table" if b["k"] == "table" else (b["k"], plain(b)) for b in blocks]
    assert made == told
    assert flow.paragraphs(spread.where("false"), ["block"], "line_no", F.lit(10.0), level).count() == 0


def test_streams_against_one_document_at_a_time(spark):
    r, rows, want = random.Random(5), [], {}
    kinds = ["p", "p", "p", "li", "h1", "h2", "dropcap", "table"]
    texts = ["Abre.", "abre", "segue sem fim", "e continua", "Título", "título ", "T", "ção", " x"]
    for across in (True, False):
        for doc in range(60):
            stream = []
            for page in range(r.randrange(1, 6)):
                stream.append({"k": "break", "n": page + 1})
                for i in range(r.randrange(1, 6)):
                    kind, text = r.choice(kinds), r.choice(texts)
                    stream.append({"k": kind, "runs": [[text, False, False, False]], "ordered": False} if kind != "table" else {"k": "table", "rows": [], "th": []})
                    rows.append((across, doc, page, i, kind, text if kind != "table" else ""))
            want[across, doc] = [(b["k"], plain(b)) for b in J.tidy(stream, across)]
    for across in (True, False):
        blocks = spark.createDataFrame([x[1:] for x in rows if x[0] == across], "doc int, page_no int, ord int, kind string, text string")
        got = {}
        for x in flow.tidied(blocks, "doc", across).orderBy("doc", "ord").collect():
            got.setdefault((across, x["doc"]), []).append((x["kind"], x["text"]))
        assert got == {k: v for k, v in want.items() if k[0] == across}
