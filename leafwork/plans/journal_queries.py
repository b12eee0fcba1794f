"""Queries on rolls, references, HTML and journals over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions import rolls as R
from leafwork.functions.rolls import find_rolls, loss_cell
from leafwork.functions.text import half_points
from leafwork.operators import flow, frames
from leafwork.operators import journal as J
from leafwork.operators.gridless import Spans, page_tables
from leafwork.operators.segments import group_slices, heads, starts, whole_groups
from leafwork.sources.layout import LINES_SQL, book_lines, page_lines, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Each part is asked for by another name, difficulty, form and number of dice.
_WHAT = [(n, "skill", n) for n in R.SKILLS] + [(n, "characteristic", k) for n, k in R.CHARACTERISTICS.items()] + [(n, "attribute", k) for n, k in R.ATTRIBUTES.items()]
_HARD = ["", *R.HARDNESS]
_CODE = ["", *(R.DIFFICULTIES[h.lower()] for h in R.HARDNESS)]
_POOLS = {"": "", " com um dado de bônus": "+1", ", with two penalty dice": "-2", " com 3 dados de penalidade": "-3", " with a bonus die": "+1", ", com duas": ""}
_ASK = f"""ask AS (SELECT p_partkey, p_name, {_listed([w[0] for w in _WHAT])}[p_partkey % {len(_WHAT)} + 1] AS name, {_listed([w[1] for w in _WHAT])}[p_partkey % {len(_WHAT)} + 1] AS kind, {_listed([w[2] for w in _WHAT])}[p_partkey % {len(_WHAT)} + 1] AS value,
  {_listed(_HARD)}[p_size % {len(_HARD)} + 1] AS hard, {_listed(_CODE)}[p_size % {len(_HARD)} + 1] AS code, {_listed(list(_POOLS))}[p_partkey // 3 % {len(_POOLS)} + 1] AS pool, {_listed(list(_POOLS.values()))}[p_partkey // 3 % {len(_POOLS)} + 1] AS dice, p_partkey % 2 = 0 AS asked FROM part),
sh AS (SELECT *, CASE WHEN asked THEN 'teste ' || CASE WHEN hard = '' THEN '' ELSE hard || ' ' END || 'de ' || name ELSE CASE WHEN hard = '' THEN '' ELSE hard || ' ' END || name || ' roll' END || CASE WHEN dice = '' THEN '' ELSE pool END AS shown FROM ask)"""


@query("f10_f14_j18_checks", f"""WITH {_ASK} SELECT p_partkey, 'Um @coc7.check[subtype:' || kind || ',name:' || value || CASE WHEN hard = '' THEN '' ELSE ',difficulty:' || code END || CASE WHEN dice = '' THEN '' ELSE ',poolModifier:' || dice END || ']{{' || shown || '}}'
 || CASE WHEN dice = '' THEN pool ELSE '' END || '; ' || p_name AS text FROM sh""")
def f10_f14_j18_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    key = F.col("p_partkey")
    name, hard, pool = of([w[0] for w in _WHAT], key % len(_WHAT)), of(_HARD, F.col("p_size") % len(_HARD)), of(list(_POOLS), F.expr("p_partkey div 3") % len(_POOLS))
    hard = F.when(hard == "", "").otherwise(F.concat(hard, F.lit(" ")))
    said = F.when(key % 2 == 0, F.concat(F.lit("teste "), hard, F.lit("de "), name)).otherwise(F.concat(hard, name, F.lit(" roll")))
    return frames.spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", frames.linked_text(find_rolls, R.openers)(F.concat(F.lit("Um "), said, pool, F.lit("; "), F.col("p_name"))).alias("text"))


# Each line loses by other dice and words; the shown text of a link keeps what was written.
_DICE = ["0", "1", "1d4", "1D6", "2d6+1", "1D10 + 2", "d3"]
_LOSE = [("Perda de Sanidade: ", ""), ("Sanity loss (", ") SAN"), ("", " SAN"), ("(", ") pontos de Sanidade"), ("teste de SAN – ", ""), ("", " de Sanidade perdida"), ("Some ", " points")]
_LOST = f"""ls AS (SELECT l_orderkey, l_linenumber, {_listed(_DICE)}[l_partkey % {len(_DICE)} + 1] AS a, {_listed(_DICE)}[l_suppkey % {len(_DICE)} + 1] AS b, {_listed([x[0] for x in _LOSE])}[l_orderkey % {len(_LOSE)} + 1] AS h, {_listed([x[1] for x in _LOSE])}[l_orderkey % {len(_LOSE)} + 1] AS t FROM lineitem),
lt AS (SELECT *, h || a || '/' || b || t AS shown FROM ls)"""


@query("f11_f12_losses", f"""WITH {_LOST} SELECT l_orderkey, l_linenumber, 'Perde ' || CASE WHEN t = ' points' THEN shown ELSE '@coc7.sanloss[sanMin:' || upper(replace(a, ' ', '')) || ',sanMax:' || upper(replace(b, ' ', '')) || ']{{' || shown || '}}' END || '.' AS text FROM lt""")
def f11_f12_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), (F.col(k) % len(values)).cast("int"))
    text = F.concat(F.lit("Perde "), of([x[0] for x in _LOSE], "l_orderkey"), of(_DICE, "l_partkey"), F.lit("/"), of(_DICE, "l_suppkey"), of([x[1] for x in _LOSE], "l_orderkey"), F.lit("."))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.linked_text(find_rolls, R.openers)(text).alias("text"))


@query("f8_f9_loss_cells", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '@coc7.sanloss[sanMin:' || o_orderkey % 4 || ',sanMax:1D' || o_orderkey % 10 || '+1]{' || o_orderkey % 4 || ' / 1d' || o_orderkey % 10 || ' + 1}' END AS cell FROM orders")
def f8_f9_loss_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "none").otherwise(F.concat((k % 4).cast("string"), F.lit(" / 1d"), (k % 10).cast("string"), F.lit(" + 1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.text_function(loss_cell)(text).alias("cell"))


_NAMES = "n AS (SELECT p_size AS doc_id, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE 'Chapter ' || p_partkey % 12 || ' of ' || p_name END AS name, 't' || p_partkey AS target FROM part)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("Chapter "), (k % 12).cast("string"), F.lit(" of "), F.col("p_name")))
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), k.alias("ord"), name.alias("name"), F.concat(F.lit("t"), k.cast("string")).alias("target"))


# Orders refer to parts by name, by chapter and by printed page; every second one to a part of another document.
# A name that begins with a chapter's number is read as that chapter where a verb stands right before it.
_REFS = f"""{_NAMES}, pt AS (SELECT n.*, p_size, row_number() OVER (ORDER BY ord) - 1 AS k FROM n JOIN part ON p_partkey = ord), m AS (SELECT count(*) AS m FROM part),
rf AS (SELECT o_orderkey AS text_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN p_size ELSE o_custkey % 50 + 1 END AS INTEGER) AS doc_id, name AS said, CASE WHEN o_orderkey % 3 = 0 THEN 's' ELSE '' END AS tail, o_orderkey % 14 AS ch, o_orderkey % 30 AS pg,
  ['Veja também ', 'see the "', 'conforme ', 'lembra '][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS verb, ['ver capítulo ', '(Chapter ', 'ver o cap. ', 'no capítulo '][CAST(o_orderkey // 4 % 4 + 1 AS INTEGER)] AS cv, ['), ', '; ', ' e ', ' '][CAST(o_orderkey % 5 % 4 + 1 AS INTEGER)] AS mid,
  ['(p. ', ', pág. ', 'vide a página ', 'na p. '][CAST(o_orderkey // 16 % 4 + 1 AS INTEGER)] AS pv FROM orders, m JOIN pt ON k = o_orderkey % m)"""


@query("f25_j16_j19_references", f"""WITH {_REFS},
h AS (SELECT doc_id, lower(name) AS key, min(target) AS target FROM n GROUP BY ALL HAVING count(*) = 1 AND length(lower(name)) >= 4),
c AS (SELECT doc_id, CAST(regexp_extract(name, '^Chapter ([0-9]+)', 1) AS INTEGER) AS ch, arg_min(target, ord) AS target FROM n WHERE name LIKE 'Chapter %' GROUP BY ALL),
pp AS (SELECT doc_id, printed AS pg, target FROM (SELECT p_size AS doc_id, CAST(p_partkey % 25 AS INTEGER) AS printed, arg_min('p' || p_partkey, p_partkey) AS target FROM part GROUP BY ALL)),
hit AS (SELECT text_id, doc_id, arg_max(target, length(key)) AS target, max(length(key)) AS len FROM rf JOIN h USING (doc_id) WHERE verb <> 'lembra ' AND starts_with(lower(said || tail), key) AND NOT regexp_matches(substring(lower(said || tail), length(key) + 1, 1), '^[\\pL\\pN]') GROUP BY ALL)
SELECT text_id, doc_id, verb || CASE WHEN d.target IS NOT NULL THEN '@UUID[' || d.target || ']{{' || regexp_extract(said, '^Chapter [0-9]+') || '}}' || regexp_replace(said, '^Chapter [0-9]+', '') || tail WHEN hit.target IS NULL THEN said || tail ELSE '@UUID[' || hit.target || ']{{' || substring(said || tail, 1, len) || '}}' || substring(said || tail, len + 1) END || '; '
  || CASE WHEN c.target IS NULL OR cv = 'no capítulo ' THEN cv || rf.ch ELSE regexp_replace(cv, '(cap|Chap).*$', '') || '@UUID[' || c.target || ']{{' || regexp_extract(cv, '(cap|Chap).*$') || rf.ch || '}}' END || mid
  || CASE WHEN pp.target IS NULL OR pv = 'na p. ' THEN pv || rf.pg ELSE regexp_replace(pv, 'p[.á].*$', '') || '@UUID[.' || pp.target || ']{{' || regexp_extract(pv, 'p[.á].*$') || rf.pg || '}}' END || '.' AS text
FROM rf LEFT JOIN hit USING (text_id, doc_id) LEFT JOIN c ON c.doc_id = rf.doc_id AND c.ch = rf.ch LEFT JOIN pp ON pp.doc_id = rf.doc_id AND pp.pg = rf.pg
  LEFT JOIN c d ON d.doc_id = rf.doc_id AND verb = 'conforme ' AND CAST(d.ch AS VARCHAR) = regexp_extract(said, '^Chapter ([0-9]+)', 1)""")
def f25_j16_j19_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, part, o = _names(spark, sf_dir), table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    k, of = F.col("o_orderkey"), lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    numbered = names.select(F.col("doc_id").alias("own"), F.col("name").alias("said"), (F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("k"))
    said = o.withColumn("k", k % part.count()).join(numbered, "k")
    text = F.concat(
        of(["Veja também ", "see the \"", "conforme ", "lembra "], k % 4), F.col("said"), F.when(k % 3 == 0, "s").otherwise(""), F.lit("; "),
        of(["ver capítulo ", "(Chapter ", "ver o cap. ", "no capítulo "], F.expr("o_orderkey div 4") % 4), (k % 14).cast("string"), of(["), ", "; ", " e ", " "], k % 5 % 4),
        of(["(p. ", ", pág. ", "vide a página ", "na p. "], F.expr("o_orderkey div 16") % 4), (k % 30).cast("string"), F.lit("."),
    )
    texts = said.select(k.alias("text_id"), F.when(k % 2 == 0, F.col("own")).otherwise((F.col("o_custkey") % 50 + 1).cast("int")).alias("doc_id"), text.alias("text"))
    page = (F.col("p_partkey") % 25).cast("int")
    printed = part.select(F.col("p_size").alias("doc_id"), page.alias("printed"), (page + 2).alias("pdf_page")).distinct()
    pages = part.select(F.col("p_size").alias("doc_id"), (page + 2).alias("pdf_page"), F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page_id"))
    return frames.linked_references(texts, names, pages, printed).select("text_id", "doc_id", "text")


@query("a11_o3_unique_headings", f"WITH {_NAMES} SELECT doc_id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key, min(target) AS target FROM n GROUP BY ALL HAVING count(*) = 1 AND length(lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))) >= 4")
def a11_o3_unique_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.unique_headings(_names(spark, sf_dir))


@query("a12_j19_chapters", f"WITH {_NAMES} SELECT doc_id, CAST(regexp_extract(name, '^Chapter ([0-9]+)', 1) AS INTEGER) AS n, arg_min(target, ord) AS target FROM n WHERE name LIKE 'Chapter %' GROUP BY ALL")
def a12_j19_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.chapter_targets(_names(spark, sf_dir))


@query("j16_longest_heading", f"""WITH {_NAMES}, h AS (SELECT doc_id, lower(name) AS key, min(target) AS target FROM n GROUP BY ALL HAVING count(*) = 1 AND length(lower(name)) >= 4),
r AS (SELECT doc_id, ord AS ref_id, name || CASE WHEN ord % 4 = 0 THEN 'x' ELSE ', and more' END AS rest FROM n)
SELECT doc_id, ref_id, arg_max(target, length(key)) AS target FROM r JOIN h USING (doc_id) WHERE starts_with(lower(rest), key) AND NOT regexp_matches(substring(lower(rest), length(key) + 1, 1), '^[\\pL\\pN]') GROUP BY ALL""")
def j16_longest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    refs = names.select("doc_id", F.col("ord").alias("ref_id"), F.concat("name", F.when(F.col("ord") % 4 == 0, "x").otherwise(", and more")).alias("rest"))
    return frames.longest_heading(refs, frames.unique_headings(names))


@query("j15_page_references", """WITH r AS (SELECT o_custkey % 50 AS doc_id, o_orderkey AS ref_id, CAST(o_orderkey % 30 AS INTEGER) AS printed FROM orders), p AS (SELECT DISTINCT o_custkey % 50 AS doc_id, CAST(o_orderkey % 20 AS INTEGER) AS printed, CAST(o_orderkey % 20 + 2 AS INTEGER) AS pdf_page FROM orders),
g AS (SELECT o_custkey % 50 AS doc_id, CAST(o_orderkey % 25 AS INTEGER) AS pdf_page, arg_min('p' || o_orderkey, o_orderkey) AS page_id FROM orders GROUP BY ALL) SELECT doc_id, ref_id, page_id FROM r JOIN p USING (doc_id, printed) JOIN g USING (doc_id, pdf_page)""")
def j15_page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    doc = (F.col("o_custkey") % 50).alias("doc_id")
    refs = o.select(doc, k.alias("ref_id"), (k % 30).cast("int").alias("printed"))
    printed = o.select(doc, (k % 20).cast("int").alias("printed"), (k % 20 + 2).cast("int").alias("pdf_page")).distinct()
    pages = o.select(doc, (k % 25).cast("int").alias("pdf_page"), k.alias("ord"), F.concat(F.lit("p"), k.cast("string")).alias("page_id"))
    return frames.page_targets(refs, printed, pages)


@query("f19_runs_html", "SELECT p_partkey, '<strong>' || replace(p_name, '&', '&amp;') || '</strong> <em>' || p_brand || '</em><sup>' || p_size || '</sup> a &lt; b' AS html FROM part")
def f19_runs_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def html(name: pd.Series, brand: pd.Series, size: pd.Series) -> pd.Series:
        runs = ([[n + " ", True, False, False], [" ", False, False, False], [b, False, True, False], [str(s), False, False, True], [" a < b ", False, False, False]] for n, b, s in zip(name, brand, size, strict=True))
        return pd.Series([J.runs_html(r) for r in runs])

    return frames.spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html("p_name", "p_brand", "p_size").alias("html"))


@query("f20_f21_j21_render", """SELECT p_partkey, '<h2>' || p_brand || '</h2>' || chr(10) || '<ul><li>' || p_name || '</li><li>b</li></ul>' || chr(10) || '<table><thead><tr><th>Nome</th><th>SAN</th></tr></thead><tbody><tr><td>' || p_type || '</td><td>@coc7.sanloss[sanMin:0,sanMax:1D' || p_size || ']{0/1D' || p_size || '}</td></tr></tbody></table>' || chr(10)
 || '<blockquote><p><strong>faça </strong>@coc7.check[subtype:attribute,name:lck]{teste de Sorte} ou fuja</p></blockquote>' || chr(10) || '<p><img src="a/x.webp" width="133"></p>' AS html FROM part""".replace("<strong>faça </strong>", "<strong>faça</strong> "))
def f20_f21_j21_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def html(brand: pd.Series, name: pd.Series, kind: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        run = lambda t, bold=False: [t, bold, False, False]
        for b, n, k, s in zip(brand, name, kind, size, strict=True):
            blocks = [
                {"k": "h2", "runs": [run(b, True)]}, {"k": "li", "ordered": False, "runs": [run(n)]}, {"k": "li", "ordered": False, "runs": [run("b")]},
                {"k": "table", "rows": [["Nome", "SAN"], ["", ""], [k, f"0/1D{s}"]], "th": [0]},
                {"k": "box", "children": [{"k": "p", "runs": [run("faça ", True), run("teste "), run("de Sorte", False), run(" ou fuja")]}]}, {"k": "image", "file": "x.webp", "w": 100.0},
            ]
            out.append(J.render(blocks, lambda f: f"a/{f}", find_rolls, True))
        return pd.Series(out)

    return frames.spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html("p_brand", "p_name", "p_type", "p_size").alias("html"))


_PAGES = "pg AS (SELECT p_size AS doc_id, p_partkey AS ord, 'Book ' || p_size AS name, p_name AS title, '<p>ver @UUID[.x]{' || p_brand || '}</p>' AS html FROM part), pi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM pg)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("Book "), size).alias("name"), F.col("p_name").alias("title"), F.concat(F.lit("<p>ver @UUID[.x]{"), F.col("p_brand"), F.lit("}</p>")).alias("html"))


_STATS = "{'coreVersion': '13.351', 'createdTime': 0, 'modifiedTime': 0}"
_ENTRY = f"""je AS (SELECT doc_id, min(name) AS name, list({{'_id': sha256(doc_id || chr(31) || (k - 1))[1:16], 'name': title, 'type': 'text', 'title': {{'show': true, 'level': 1}}, 'text': {{'content': html, 'format': 1}}, 'sort': k * 100000, 'ownership': {{'default': -1}}, '_stats': {_STATS}}} ORDER BY ord) AS pages,
  string_agg('<article><h1>' || title || '</h1>' || regexp_replace(html, '@UUID\\[([^\\]]*)\\]\\{{([^}}]*)\\}}', '<span class="link" title="@UUID[\\1]">📄 \\2</span>', 'g') || '</article>', '' ORDER BY ord) AS preview FROM pi GROUP BY doc_id)"""


@query("s10_s16_s17_f27_journal_json", f"WITH {_PAGES}, {_ENTRY} SELECT doc_id, CAST(to_json({{'name': name, 'pages': pages, 'folder': CAST(NULL AS VARCHAR), 'sort': 0, 'ownership': {{'default': 0}}, '_stats': {_STATS}}}) AS VARCHAR) AS entry FROM je")
def s10_s16_s17_f27_journal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.journals(_pages(spark, sf_dir)).select("doc_id", "entry")


@query("s11_macro", f"WITH {_PAGES}, {_ENTRY} SELECT doc_id, 'const data = ' || CAST(to_json({{'name': name, 'pages': pages, 'folder': CAST(NULL AS VARCHAR), 'sort': 0, 'ownership': {{'default': 0}}}}) AS VARCHAR) || ';' || chr(10) || 'const entry = await JournalEntry.create(data);' || chr(10) || 'entry?.sheet.render(true);' || chr(10) AS macro FROM je")
def s11_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.journals(_pages(spark, sf_dir)).select("doc_id", "macro")


@query("s12_f24_preview", f"WITH {_PAGES}, {_ENTRY} SELECT doc_id, preview FROM je")
def s12_f24_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.journals(_pages(spark, sf_dir)).select("doc_id", "preview")


#: Bytes of lines whose words are laid out at once.
_SLICE_BYTES = 1_000_000
_BODY, _LEVELS = 10.0, {18.0: 1, 14.0: 2}
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PARAGRAPHS = LINES_SQL + f""",
l0 AS (SELECT book_id, page_no, line_no, replace(text, chr(173), '') AS text, x0, y0, x1, y1, bold, round_even(size * 2, 0) / 2 AS size, {_TRIM.format("replace(text, chr(173), '')")} AS t FROM lines),
l1 AS (SELECT *, CASE WHEN length(t) <= 2 AND regexp_full_match(t, '\\pL+') AND size >= 18 THEN 'dropcap' WHEN size = 18 THEN 'h1' WHEN size = 14 THEN 'h2' ELSE 'p' END AS kind,
  length(regexp_extract(text, '^(\\s*[•●▪■◦○▸►–—*·-]\\s+|\\s*([0-9]{{1,3}}|[a-zA-Z])[.)]\\s+)')) AS mark, regexp_matches(t, '^[A-ZÀ-Ý][\\pL\\pN_À-ÿ%/()'' -]{{1,32}}:\\s*\\S') AS lab,
  regexp_matches(t, '^[\\p{{Lu}}0-9]') AS cap, regexp_matches(t, '[.!?:…"”»)]$') AS ends FROM l0 WHERE t <> ''),
l2 AS (SELECT *, min(x0) OVER pg AS lft, max(x1) OVER pg AS rgt, (count(*) FILTER (WHERE lab) OVER pg) >= greatest(2, 0.4 * count(*) OVER pg) AS sheet,
  lag(kind) OVER w AS pk, lag(y1) OVER w AS py1, lag(x1) OVER w AS px1, lag(bold) OVER w AS pb, lag(lab) OVER w AS plab, lag(ends) OVER w AS pends, lag(t) OVER w AS pt
  FROM l1 WINDOW pg AS (PARTITION BY book_id, page_no), w AS (PARTITION BY book_id, page_no ORDER BY line_no)),
l3 AS (SELECT *, pk IS NULL OR pk <> kind OR kind = 'dropcap' OR kind = 'p' AND (mark > 0 OR y0 - py1 > 0.7 * size) AS hard,
  CASE WHEN sheet THEN cap AND NOT regexp_matches(pt, '[-,(]$') ELSE x0 > lft + greatest(6, 0.8 * size) OR plab AND lab OR cap AND pends AND px1 < rgt - 3 * size END AS looks, NOT sheet AND pb AND NOT bold AS turns FROM l2),
l4 AS (SELECT *, sum(hard::INT) OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS seg FROM l3),
l5 AS (SELECT *, first(kind = 'p' AND mark = 0) OVER (PARTITION BY book_id, page_no, seg ORDER BY line_no) AS free FROM l4),
l6 AS (SELECT *, hard OR free AND looks AS plainly FROM l5),
l7 AS (SELECT *, hard OR free AND (looks OR turns AND lag(plainly) OVER (PARTITION BY book_id, page_no ORDER BY line_no)) AS new FROM l6),
l8 AS (SELECT *, sum(new::INT) OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS para FROM l7),
l9 AS (SELECT *, CASE WHEN new THEN substring(text, (CASE WHEN kind = 'p' THEN mark ELSE 0 END) + 1) ELSE regexp_replace(text, '^\\s+', '') END AS piece,
  lead(regexp_replace(text, '^\\s+', '')) OVER (PARTITION BY book_id, page_no, para ORDER BY line_no) AS nxt FROM l8),
l10 AS (SELECT *, CASE WHEN nxt IS NULL THEN piece WHEN regexp_matches(piece, '\\pL-\\s*$') AND regexp_matches(nxt, '^\\p{{Ll}}') THEN regexp_replace(piece, '-\\s*$', '') WHEN ends_with(piece, ' ') THEN piece ELSE regexp_replace(piece, '\\s+$', '') || ' ' END AS glued FROM l9),
l11 AS (SELECT book_id, page_no, para, arg_min(CASE WHEN kind = 'p' AND mark > 0 THEN 'li' ELSE kind END, line_no) AS kind, count(*) AS lines, bool_and(bold) AS bold, {_TRIM.format("string_agg(glued, '' ORDER BY line_no)")} AS text FROM l10 GROUP BY ALL),
blocks AS (SELECT book_id, page_no, CAST(row_number() OVER (PARTITION BY book_id, page_no ORDER BY para) - 1 AS INTEGER) AS ord,
  CASE WHEN kind = 'p' AND lines = 1 AND bold AND length(text) < 70 AND NOT regexp_matches(text, '[.,;:]$') THEN 'h4' WHEN kind IN ('h1', 'h2') AND length(text) > 200 THEN 'p' ELSE kind END AS kind, CAST(lines AS INTEGER) AS lines, text FROM l11 WHERE text <> '')"""


@query("w5_w6_paragraphs", f"WITH {_PARAGRAPHS} SELECT * FROM blocks")
def w5_w6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each synthetic page: book_id, page_no, ord, kind, lines, text."""
    sized = book_lines(spark, sf_dir, together=True).withColumn("size", half_points(F.col("size")))
    keys = ["book_id", "page_no"]
    lines = flow.same_row(sized.select(*keys, "line_no", "text", "size", "bold", "x0", "y0", "x1", "y1"), keys, "line_no")
    whole = lambda c: F.col("parts")[0][c]
    read = lines.select(*keys, "line_no", F.array_join(F.transform("parts", lambda p: p.text), "").alias("text"), whole("size").alias("size"), F.forall("parts", lambda p: p.bold).alias("bold"), "x0", "y0", "x1", "y1")
    level = F.coalesce(*(F.when(F.col("size") == size, level) for size, level in _LEVELS.items()))
    return flow.paragraphs(read, keys, "line_no", F.lit(_BODY), level)


@query("w7_w10_j14_text_tables", None)
def w7_w10_j14_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridless tables of each synthetic page: a line's words are set in rows of five columns; rows as JSON."""

    keys = ["book_id", "page_no"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, words = np.cumsum(starts(batch, keys)) - 1, pc.split_pattern(batch.column("text"), " ")
        count, line_no = pc.list_value_length(words).to_numpy(zero_copy_only=False), batch.column("line_no").to_numpy().astype(np.int64)
        line = np.repeat(np.arange(len(count)), count)
        page, no, text = lines[line], np.arange(len(line)) - (np.cumsum(count) - count)[line], words.flatten()
        line = line_no[line]
        if ((np.diff(page) == 0) & (np.diff(line) < 1) & (np.diff(no) != 1)).any():  # documents of one number make one page
            order = np.lexsort((no, line, page))
            page, line, no, text = page[order], line[order], no[order], text.take(pa.array(order))
        row = np.cumsum(np.append(True, (np.diff(page) != 0) | (np.diff(line) != 0) | (np.diff(no // 5) != 0))[: len(page)]) - 1
        first = heads(row)
        y = 14.0 * (row - row[heads(page)][page]) + 40.0 * line
        x = 54 + 90.0 * (no % 5)
        found, used = page_tables(Spans(page, page, row, text, x, y, x + 60, y + 10, np.full(len(x), 10.0), np.zeros(len(x), bool)), 10.0, 612.0)
        told = np.array([p for p, _, _ in found], np.int64)
        lines_used = np.bincount(page[first[used]], minlength=lines[-1] + 1)[told]
        at = pa.array(heads(lines)[told])
        number = np.arange(len(told)) - np.searchsorted(told, told)
        rows = map(json.JSONEncoder(ensure_ascii=False).encode, (t["rows"] for _, _, t in found))
        return pa.record_batch([*(batch.column(k).take(at) for k in keys), pa.array(number, pa.int32()), pa.array(lines_used, pa.int32()), pa.array(rows, pa.string())], names=[*keys, "table_no", "used_lines", "rows"])

    def each(batches):
        for batch in whole_groups(batches, keys):
            yield from map(run, group_slices(batch, keys, "text", _SLICE_BYTES))

    return page_lines(spark, sf_dir).mapInArrow(each, "book_id long, page_no int, table_no int, used_lines int, rows string")


_TIDY = _PARAGRAPHS + f""",
s0 AS (SELECT book_id, page_no, ord, kind, text, CASE WHEN kind[1] = 'h' THEN kind || '|' || lower(regexp_replace({_TRIM.format('text')}, '\\s+', ' ', 'g')) END AS title FROM blocks),
pt AS (SELECT book_id, page_no, arg_max(title, ord) AS last FROM s0 GROUP BY ALL),
pl AS (SELECT book_id, page_no, last_value(last IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pt),
s1 AS (SELECT s0.*, bool_and(coalesce(title = before, false)) OVER (PARTITION BY book_id, page_no ORDER BY ord) AS again FROM s0 JOIN pl USING (book_id, page_no)),
s2 AS (SELECT *, count(*) FILTER (WHERE kind <> 'dropcap') OVER (PARTITION BY book_id ORDER BY page_no, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM s1 WHERE NOT again),
dc AS (SELECT book_id, g, string_agg({_TRIM.format('text')}, '' ORDER BY page_no, ord) AS pre FROM s2 WHERE kind = 'dropcap' GROUP BY ALL),
s3 AS (SELECT book_id, page_no, ord, kind, coalesce(pre, '') || text AS text FROM s2 LEFT JOIN dc USING (book_id, g) WHERE kind <> 'dropcap'),
s4 AS (SELECT *, coalesce(kind = 'p' AND lag(kind) OVER w IN ('p', 'li') AND NOT regexp_matches(lag(text) OVER w, '[.!?:…"”»)]\\s*$') AND regexp_matches(text, '^\\s*\\p{{Ll}}'), false) AS joins FROM s3 WINDOW w AS (PARTITION BY book_id ORDER BY page_no, ord)),
s5 AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY book_id ORDER BY page_no, ord) AS grp FROM s4),
s6 AS (SELECT book_id, grp, min(page_no) AS page_no, arg_min(ord, page_no * 100000 + ord) AS o, arg_min(kind, page_no * 100000 + ord) AS kind, string_agg(text, ' ' ORDER BY page_no, ord) AS text FROM s5 GROUP BY ALL),
st AS (SELECT book_id, page_no, o, kind, text FROM s6 UNION ALL SELECT DISTINCT book_id, page_no, -1, 'break', '' FROM blocks)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_no, o) - 1 AS INTEGER) AS ord, kind, text FROM st"""


@query("w11_tidy", f"WITH {_TIDY}")
def w11_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidied stream of each synthetic book: paragraphs joined over pages, repeated titles dropped."""

    blocks = w5_w6_paragraphs(spark, sf_dir).where("kind <> 'table'")
    return flow.tidied(blocks, "book_id")
