"""Queries on order, runs and spans over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.operators import ordering as O
from leafwork.sources.layout import LINES_SQL, RECTS_SQL, SPANS_SQL, book_lines, page_rects, table, word_spans

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_PAGE = ["book_id", "page_no"]
_LINE = ["book_id", "page_no", "line_no"]
_BAND = RECTS_SQL + """,
rg AS (SELECT *, min(x0) OVER (PARTITION BY book_id, page_no) AS rx0, max(x1) OVER (PARTITION BY book_id, page_no) AS rx1 FROM rects),
wd AS (SELECT *, CAST(x1 - x0 >= 0.6 * greatest(1.0, rx1 - rx0) AS INTEGER) AS wide FROM rg),
bd AS (SELECT *, sum(wide * 2) OVER (PARTITION BY book_id, page_no ORDER BY y0, x0, item_no ROWS UNBOUNDED PRECEDING) - wide AS band FROM wd)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*_PAGE)
    return page_rects(spark, sf_dir).withColumns({"rx0": F.min("x0").over(w), "rx1": F.max("x1").over(w)})


@query("w2_bands", f"WITH {_BAND} SELECT book_id, page_no, item_no, CAST(band AS BIGINT) AS band FROM bd")
def w2_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bands(_regions(spark, sf_dir), _PAGE).select(*_PAGE, "item_no", F.col("band").cast("long").alias("band"))


@query("w3_column_islands", f"""WITH {_BAND}, c AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY book_id, page_no, band ORDER BY x0, x1, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS st FROM bd)
SELECT book_id, page_no, item_no, CAST(sum(st) OVER (PARTITION BY book_id, page_no, band ORDER BY x0, x1, item_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS col FROM c""")
def w3_column_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = O.bands(_regions(spark, sf_dir), _PAGE)
    return O.columns(banded, [*_PAGE, "band"]).select(*_PAGE, "item_no", F.col("col").cast("long").alias("col"))


@query("w4_o1_reading_order", f"""WITH RECURSIVE {RECTS_SQL},
t AS (SELECT book_id, page_no, item_no, x0, y0, x1, []::BIGINT[] AS path, true AS open FROM rects UNION ALL
  SELECT book_id, page_no, item_no, x0, y0, x1, path || [band, col], cols > 0 AND count(*) OVER (PARTITION BY book_id, page_no, path, band, col) > 1 FROM (
  SELECT *, max(col) OVER (PARTITION BY book_id, page_no, path, band) AS cols FROM (
  SELECT *, CAST(sum(st) OVER (PARTITION BY book_id, page_no, path, band ORDER BY x0, x1, item_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS col FROM (
  SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY book_id, page_no, path, band ORDER BY x0, x1, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS st FROM (
  SELECT *, CAST(sum(wide * 2) OVER (PARTITION BY book_id, page_no, path ORDER BY y0, x0, item_no ROWS UNBOUNDED PRECEDING) - wide AS BIGINT) AS band FROM (
  SELECT *, CAST(x1 - x0 >= 0.6 * greatest(1.0, max(x1) OVER (PARTITION BY book_id, page_no, path) - min(x0) OVER (PARTITION BY book_id, page_no, path)) AS BIGINT) AS wide FROM t WHERE open))))))
SELECT book_id, page_no, item_no, row_number() OVER (PARTITION BY book_id, page_no ORDER BY path, y0, x0, item_no) AS place FROM t WHERE NOT open""")
def w4_o1_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reading_order(page_rects(spark, sf_dir), _PAGE).select(*_PAGE, "item_no", F.col("place").cast("long").alias("place"))


@query("p19_a8_line_text", f"""WITH {SPANS_SQL}, t AS (SELECT *, lag(text) OVER w AS pt, lag(x1) OVER w AS px FROM spans WHERE text <> '' WINDOW w AS (PARTITION BY book_id, page_no, line_no ORDER BY span_no))
SELECT book_id, page_no, line_no, string_agg(CASE WHEN x0 - px > 0.2 * size AND NOT ends_with(pt, ' ') AND NOT starts_with(text, ' ') THEN ' ' ELSE '' END || text, '' ORDER BY span_no) AS line FROM t GROUP BY ALL""")
def p19_a8_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.join_spans(word_spans(spark, sf_dir), _LINE)


@query("w8_w9_cells", f"""WITH {SPANS_SQL}, t AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY book_id, page_no, line_no ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= size THEN 1 ELSE 0 END AS st FROM spans WHERE trim(text) <> ''),
c AS (SELECT *, CAST(sum(st) OVER (PARTITION BY book_id, page_no, line_no ORDER BY span_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell FROM t)
SELECT book_id, page_no, line_no, cell, trim(regexp_replace(string_agg(text, ' ' ORDER BY span_no), '\\s+', ' ', 'g')) AS text, min(x0) AS x0, max(x1) AS x1, bool_and(bold) AS bold FROM c GROUP BY ALL""")
def w8_w9_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_cells(word_spans(spark, sf_dir), _LINE)


_ANCH = RECTS_SQL + """, a0 AS (SELECT book_id, page_no, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY book_id, page_no ORDER BY x0) > 8 THEN 1 ELSE 0 END AS st FROM rects),
a1 AS (SELECT *, CAST(sum(st) OVER (PARTITION BY book_id, page_no ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS BIGINT) AS anchor FROM a0),
anc AS (SELECT book_id, page_no, anchor, sum(x0) / count(*) AS ax FROM a1 GROUP BY ALL)"""


@query("a9_column_anchors", f"WITH {_ANCH} SELECT * FROM anc")
def a9_column_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.anchors(page_rects(spark, sf_dir), _PAGE)


@query("j13_nearest_anchor", f"WITH {_ANCH} SELECT book_id, page_no, item_no, anchor FROM rects JOIN anc USING (book_id, page_no) QUALIFY row_number() OVER (PARTITION BY book_id, page_no, item_no ORDER BY abs(x0 - ax), anchor) = 1")
def j13_nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = page_rects(spark, sf_dir)
    return O.nearest_anchor(rects, O.anchors(rects, _PAGE), _PAGE, "item_no")


@query("p18_sheets", f"WITH {LINES_SQL}, s AS (SELECT book_id, page_no, CASE WHEN line_no % 3 = 0 THEN 'Corpo ' || line_no || ': ' || size ELSE text END AS text FROM lines), c AS (SELECT book_id, page_no, count(*) FILTER (WHERE regexp_matches(trim(text), '^[A-ZÀ-Ý][0-9A-Za-z_À-ÿ%/()'' -]{{1,32}}:\\s*\\S')) AS labels, count(*) AS lines FROM s GROUP BY ALL) SELECT *, labels >= 2 AND labels >= 0.4 * lines AS sheet FROM c")
def p18_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("line_no")
    lines = book_lines(spark, sf_dir).withColumn("text", F.when(no % 3 == 0, F.concat(F.lit("Corpo "), no.cast("string"), F.lit(": "), F.col("size").cast("string"))).otherwise(F.col("text")))
    return O.sheets(lines, _PAGE)


_BLOCKS = "blk AS (SELECT l_orderkey // 8 AS doc, (l_orderkey % 8) * 10 + l_linenumber AS ord, CASE l_partkey % 6 WHEN 0 THEN 'h1' WHEN 1 THEN 'h3' WHEN 2 THEN 'li' WHEN 3 THEN 'li' WHEN 4 THEN 'li' ELSE 'p' END AS kind, l_quantity > 25 AS ordered, 'part ' || l_partkey AS text FROM lineitem)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("h1", "h3", "li", "li", "li", "p"))), (F.col("l_partkey") % 6).cast("int"))
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.expr("l_orderkey div 8").alias("doc"), ((F.col("l_orderkey") % 8) * 10 + F.col("l_linenumber")).alias("ord"), kind.alias("kind"), (F.col("l_quantity") > 25).alias("ordered"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))


@query("w12_heading_split", f"WITH {_BLOCKS}, u AS (SELECT doc, ord FROM blk GROUP BY ALL HAVING count(*) = 1), j AS (SELECT doc, ord, text, sum(CAST(kind IN ('h1', 'h2') AS INTEGER)) OVER (PARTITION BY doc ORDER BY ord) AS jpage FROM blk SEMI JOIN u USING (doc, ord)) SELECT doc, CAST(jpage AS BIGINT) AS jpage, count(*) AS blocks, string_agg(text, '|' ORDER BY ord) AS texts FROM j GROUP BY ALL")
def w12_heading_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _unique(_blocks(spark, sf_dir))
    pages = O.split_by_heading(blocks, "doc", 2)
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "|")
    return pages.groupBy("doc", "jpage").agg(F.count("*").alias("blocks"), told.alias("texts"))


def _unique(blocks: DataFrame) -> DataFrame:
    """Blocks whose ordinal is theirs alone, so that order is a function of the data."""
    return blocks.join(blocks.groupBy("doc", "ord").agg(F.count("*").alias("n")).where("n = 1").drop("n"), ["doc", "ord"], "left_semi")


@query("a16_list_groups", f"""WITH {_BLOCKS}, u AS (SELECT doc, ord FROM blk GROUP BY ALL HAVING count(*) = 1), b AS (SELECT * FROM blk SEMI JOIN u USING (doc, ord)),
f AS (SELECT *, CASE WHEN kind = 'li' AND lag(kind) OVER w = 'li' AND lag(ordered) OVER w = ordered THEN 0 ELSE 1 END AS st FROM b WINDOW w AS (PARTITION BY doc ORDER BY ord)),
g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc ORDER BY ord) AS BIGINT) AS grp FROM f) SELECT doc, grp, ordered, string_agg(text, '|' ORDER BY ord) AS items FROM g WHERE kind = 'li' GROUP BY ALL""")
def a16_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = O.list_groups(_unique(_blocks(spark, sf_dir)), "doc")
    return groups.select("doc", (F.col("grp") + 1).alias("grp"), "ordered", F.array_join("items", "|").alias("items"))


@query("w14_sort_keys_a14_counts", f"WITH {_BLOCKS}, t AS (SELECT doc, kind, count(*) AS n FROM blk GROUP BY ALL) SELECT doc, kind, n, row_number() OVER (PARTITION BY doc ORDER BY kind) * 100000 AS sort FROM t")
def w14_sort_keys_a14_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _blocks(spark, sf_dir).groupBy("doc", "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("sort", (F.row_number().over(Window.partitionBy("doc").orderBy("kind")) * 100000).cast("long"))


_TEXT = "'0123456789abcdefghij'"


@query("w15_o4_f22_splice", f"SELECT o_orderkey, substring({_TEXT}, 1, CAST(k AS INTEGER)) || '<' || k || '>' || substring({_TEXT}, CAST(k + 4 AS INTEGER), CAST(9 - k AS INTEGER)) || '{{x}}' || substring({_TEXT}, 15, 6) AS text FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)")
def w15_o4_f22_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 6).cast("int")
    span = lambda s, e, rep: F.struct(s.alias("s"), e.alias("e"), rep.alias("rep"))
    spans = F.array(span(F.lit(12), F.lit(14), F.lit("{x}")), span(k, k + 3, F.concat(F.lit("<"), k.cast("string"), F.lit(">"))), span(k + 1, k + 9, F.lit("never")))
    return table(spark, sf_dir, "orders").select("o_orderkey", O.splice(F.lit("0123456789abcdefghij"), O.first_disjoint(spans)).alias("text"))


@query("j17_u2_rolls_over_links", "SELECT o_orderkey, CASE WHEN k BETWEEN 2 AND 8 THEN '4-9' ELSE k || '-' || (k + 3) || ',4-9' END AS spans FROM (SELECT o_orderkey, o_orderkey % 12 AS k FROM orders)")
def j17_u2_rolls_over_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 12).cast("int")
    rolls, links = F.array(F.struct(F.lit(4).alias("s"), F.lit(9).alias("e"))), F.array(F.struct(k.alias("s"), (k + 3).alias("e")))
    both = F.concat(O.without_overlap(links, rolls), rolls)
    text = F.array_join(F.transform(both, lambda x: F.concat(x.s.cast("string"), F.lit("-"), x.e.cast("string"))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("spans"))


@query("o2_row_pieces", f"WITH {RECTS_SQL} SELECT book_id, page_no, string_agg(CAST(item_no AS VARCHAR), ',' ORDER BY (y0 + y1) / 2, x0, item_no) AS items FROM rects GROUP BY ALL")
def o2_row_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sort_array(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("c"), "x0", "item_no")))
    return page_rects(spark, sf_dir).groupBy(*_PAGE).agg(F.array_join(F.transform(order, lambda x: x.item_no.cast("string")), ",").alias("items"))


@query("u3_distinct_used_u5_except", "WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20), b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0)")
def u3_distinct_used_u5_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    own = lambda c: li.where(c).select("l_orderkey", "l_linenumber")
    return own("l_quantity > 20").subtract(own("l_discount > 0.05")).union(own("l_tax = 0")).distinct()


@query("o7_names_by_case", "SELECT c_mktsegment, string_agg(CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE lower(c_name) END, ',' ORDER BY lower(c_name)) AS names FROM customer GROUP BY ALL")
def o7_names_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name"))
    ordered = F.sort_array(F.collect_list(F.struct(F.lower("c_name").alias("k"), name.alias("n"))))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.array_join(F.transform(ordered, lambda x: x.n), ",").alias("names"))
