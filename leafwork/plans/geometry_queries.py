"""Queries on rectangles over the synthetic pages, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.geometry import Rect, bounds, in_margin
from leafwork.operators import geometry as G
from leafwork.operators import pixels as P
from leafwork.sources.layout import PAGE, RECTS_SQL, page_rects, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH RECURSIVE {RECTS_SQL}, {_VIEWS} {sql}"
        return f

    return add


_AREA = 612.0 * 792.0
_VIEWS = "texts AS (SELECT * FROM rects WHERE kind = 'text'), images AS (SELECT * FROM rects WHERE kind = 'image'), tabs AS (SELECT * FROM rects WHERE kind = 'table'), draws AS (SELECT *, chars % 3 = 0 AS framed FROM rects WHERE kind = 'drawing')"


def _ov(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def _ar(a: str) -> str:
    return f"(greatest(0, {a}.x1 - {a}.x0) * greatest(0, {a}.y1 - {a}.y0))"


def _in(o: str, x: str, y: str, t: float = 1.0) -> str:
    return f"({x} BETWEEN {o}.x0 - {t} AND {o}.x1 + {t} AND {y} BETWEEN {o}.y0 - {t} AND {o}.y1 + {t})"


def _bel(i: str, o: str) -> str:
    return f"({_in(o, f'({i}.x0 + {i}.x1) / 2', f'({i}.y0 + {i}.y1) / 2', 3.0)} OR {_ov(i, o)} >= 0.6 * greatest({_ar(i)}, 1.0))"


_ON = "o.book_id = t.book_id AND o.page_no = t.page_no"
_ID = ["book_id", "page_no", "item_no"]


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = page_rects(spark, sf_dir).where(F.col("kind") == kind)
    return rows.withColumn("framed", F.col("chars") % 3 == 0) if kind == "drawing" else rows


@query("j4_blocks_outside_tables", f"SELECT book_id, page_no, item_no FROM texts t WHERE NOT EXISTS (SELECT 1 FROM tabs o WHERE {_ON} AND {_in('o', '(t.x0 + t.x1) / 2', '(t.y0 + t.y1) / 2')})")
def j4_blocks_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outside(_kind(spark, sf_dir, "text"), _kind(spark, sf_dir, "table")).select(*_ID)


@query("j6_images_not_tables", f"SELECT book_id, page_no, item_no FROM images t WHERE NOT EXISTS (SELECT 1 FROM tabs o WHERE {_ON} AND {_ov('t', 'o')} > 0.5 * {_ar('t')})")
def j6_images_not_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.not_covered(_kind(spark, sf_dir, "image"), _kind(spark, sf_dir, "table"), 0.5).select(*_ID)


@query("j7_labels_in_images", f"SELECT book_id, page_no, item_no FROM texts t WHERE NOT EXISTS (SELECT 1 FROM images o WHERE {_ON} AND {_ov('t', 'o')} >= 0.8 * {_ar('t')})")
def j7_labels_in_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.labels(_kind(spark, sf_dir, "text"), _kind(spark, sf_dir, "image")).select(*_ID)


@query("j8_p14_backgrounds", f"SELECT o.book_id, o.page_no, o.item_no FROM images o JOIN texts t ON {_ON} WHERE {_ov('t', 'o')} >= 0.5 * {_ar('t')} GROUP BY ALL HAVING sum(t.chars) > 300 OR max(t.chars) > 80")
def j8_p14_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.backgrounds(_kind(spark, sf_dir, "image"), _kind(spark, sf_dir, "text"))


@query("j9_erase_lists", f"SELECT o.book_id, o.page_no, o.item_no, array_to_string(list_sort(list(t.item_no)), ',') AS erase FROM images o JOIN texts t ON {_ON} WHERE {_ov('t', 'o')} > 0 GROUP BY ALL")
def j9_erase_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.erasures(_kind(spark, sf_dir, "image"), _kind(spark, sf_dir, "text")).withColumn("erase", F.array_join("erase", ","))


@query("p13_image_filters", f"""SELECT t.book_id, t.page_no, t.item_no FROM (SELECT book_id, page_no, item_no, greatest(x0, 0.0) AS x0, greatest(y0, 0.0) AS y0, least(x1, 612.0) AS x1, least(y1, 792.0) AS y1 FROM images) t
LEFT JOIN (SELECT book_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM texts GROUP BY ALL) c0 USING (book_id, page_no),
LATERAL (SELECT coalesce(c0.x0, 0.0) AS x0, coalesce(c0.y0, 0.0) AS y0, coalesce(c0.x1, 612.0) AS x1, coalesce(c0.y1, 792.0) AS y1) c
WHERE t.x1 - t.x0 >= 48 AND t.y1 - t.y0 >= 48 AND greatest(t.x1 - t.x0, t.y1 - t.y0) <= 6 * least(t.x1 - t.x0, t.y1 - t.y0)
AND NOT ({_ar('t')} < 0.06 * {_AREA} AND {_ov('t', 'c')} < 0.3 * {_ar('t')})
AND NOT EXISTS (SELECT 1 FROM tabs o WHERE {_ON} AND {_ov('t', 'o')} > 0.5 * {_ar('t')})""")
def p13_image_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.image_candidates(_kind(spark, sf_dir, "image"), _kind(spark, sf_dir, "table"), _kind(spark, sf_dir, "text"), PAGE).select(*_ID)


_BOX = f"boxes0 AS (SELECT * FROM draws t WHERE x1 - x0 >= 40 AND y1 - y0 >= 20 AND {_ar('t')} <= 0.6 * {_AREA} AND (shade <= 0.04 OR framed)), boxes1 AS (SELECT * FROM boxes0 t WHERE NOT EXISTS (SELECT 1 FROM tabs o WHERE {_ON} AND {_ov('t', 'o')} > 0.3 * {_ar('t')}))"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.box_candidates(_kind(spark, sf_dir, "drawing").withColumn("shade", F.when(F.col("shade") <= 0.04, 0.5).otherwise(1.0)), _AREA)
    return G.not_covered(found, _kind(spark, sf_dir, "table"), 0.3)


@query("p15_j10_box_candidates", f", {_BOX} SELECT book_id, page_no, item_no FROM boxes1")
def p15_j10_box_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*_ID)


@query("j11_outermost_boxes", f", {_BOX} SELECT book_id, page_no, item_no FROM boxes1 t WHERE NOT EXISTS (SELECT 1 FROM boxes1 o WHERE {_ON} AND (o.x0, o.y0, o.x1, o.y1) <> (t.x0, t.y0, t.x1, t.y1) AND {_in('o', 't.x0', 't.y0')} AND {_in('o', 't.x1', 't.y1')})")
def j11_outermost_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outermost(_boxes(spark, sf_dir)).select(*_ID)


@query("a15_box_occupancy", f", {_BOX}, tot AS (SELECT book_id, page_no, count(*) AS total FROM texts GROUP BY ALL), h AS (SELECT o.book_id, o.page_no, o.item_no, count(*) AS n_inside FROM boxes1 o JOIN texts t ON {_ON} WHERE {_bel('t', 'o')} GROUP BY ALL) SELECT h.* FROM h JOIN tot USING (book_id, page_no) WHERE NOT (total > 3 AND n_inside >= 0.9 * total)")
def a15_box_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.occupied(_boxes(spark, sf_dir), _kind(spark, sf_dir, "text"))


@query("j12_box_membership", f", {_BOX} SELECT t.book_id, t.page_no, t.item_no, min(o.item_no) AS box_no FROM texts t JOIN boxes1 o ON {_ON} WHERE {_bel('t', 'o')} GROUP BY ALL")
def j12_box_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.memberships(_kind(spark, sf_dir, "text"), _boxes(spark, sf_dir))


@query("a7_bbox_unions", "SELECT book_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM texts GROUP BY ALL")
def a7_bbox_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind(spark, sf_dir, "text").groupBy("book_id", "page_no").agg(*bounds())


@query("j5_drop_used_lines", f", used AS (SELECT DISTINCT t.book_id, t.page_no, t.item_no FROM texts t JOIN tabs o ON {_ON} WHERE {_ov('t', 'o')} > 0), rest AS (SELECT * FROM texts ANTI JOIN used USING (book_id, page_no, item_no)) SELECT book_id, page_no, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rest GROUP BY ALL")
def j5_drop_used_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _kind(spark, sf_dir, "text")
    left = G.not_covered(texts, _kind(spark, sf_dir, "table"), 0.0)
    return left.groupBy("book_id", "page_no").agg(F.count("*").alias("n"), *bounds())


@query("p20_geometry", f"SELECT book_id, page_no, item_no, {_ar('t')} AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, y1 < 95.04 OR y0 > 696.96 OR x1 < 61.2 OR x0 > 550.8 AS margin FROM rects t")
def p20_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Rect()
    return page_rects(spark, sf_dir).select(*_ID, r.area.alias("area"), r.cx.alias("cx"), r.cy.alias("cy"), in_margin(r, PAGE).alias("margin"))


@query("u1_page_items", "SELECT book_id, page_no, item_no, kind, CASE WHEN kind = 'text' THEN chars END AS chars, CASE WHEN kind = 'image' THEN digest END AS digest FROM rects")
def u1_page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_kind(spark, sf_dir, k).select(*_ID, "kind", *([c] if c else [])) for k, c in (("text", "chars"), ("image", "digest"), ("table", None), ("drawing", None))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query("u6_images_less_backgrounds", f", bg AS (SELECT o.book_id, o.page_no, o.item_no FROM images o JOIN texts t ON {_ON} WHERE {_ov('t', 'o')} >= 0.5 * {_ar('t')} GROUP BY ALL HAVING sum(t.chars) > 300 OR max(t.chars) > 80) SELECT book_id, page_no, item_no FROM images ANTI JOIN bg USING (book_id, page_no, item_no)")
def u6_images_less_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _kind(spark, sf_dir, "image")
    return images.join(G.backgrounds(images, _kind(spark, sf_dir, "text")), _ID, "left_anti").select(*_ID)


@query("w13_image_files", "SELECT book_id, page_no, item_no, printf('book-p%03d-%02d.webp', page_no + 1, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y0, x0, x1, y1, item_no)) AS file FROM images QUALIFY count(*) OVER (PARTITION BY book_id, page_no, x0, y0, x1, y1) = 1")
def w13_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _kind(spark, sf_dir, "image")
    own = G.numbered_files(images, "book")
    alone = images.groupBy("book_id", "page_no", "x0", "y0", "x1", "y1").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return own.join(alone, ["book_id", "page_no", "x0", "y0", "x1", "y1"], "left_semi").select(*_ID, "file")


# A rectangle grows to the union of all that it meets, again and again; at the fixpoint equal ones are one.
_GROWN = "list_distinct([{x0: list_min([b.x0 FOR b IN m]), y0: list_min([b.y0 FOR b IN m]), x1: list_max([b.x1 FOR b IN m]), y1: list_max([b.y1 FOR b IN m])} FOR m IN [[b FOR b IN rs IF a.x0 - 2 < b.x1 AND b.x0 - 2 < a.x1 AND a.y0 - 2 < b.y1 AND b.y0 - 2 < a.y1] FOR a IN rs]])"


@query("a19_merged_rects", f""", g(book_id, page_no, rs, k) AS (SELECT book_id, page_no, list({{x0: x0, y0: y0, x1: x1, y1: y1}}), 0 FROM draws GROUP BY ALL
  UNION ALL SELECT book_id, page_no, list_sort(new), k + 1 FROM (SELECT *, {_GROWN} AS new FROM g) WHERE list_sort(new) <> list_sort(rs)),
l AS (SELECT book_id, page_no, unnest(list_distinct(rs)) AS r FROM g QUALIFY k = max(k) OVER (PARTITION BY book_id, page_no))
SELECT book_id, page_no, CAST(row_number() OVER (PARTITION BY book_id, page_no ORDER BY r.y0, r.x0, r.y1, r.x1) AS INTEGER) AS rect_no, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1 FROM l""")
def a19_merged_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merged(_kind(spark, sf_dir, "drawing"))


@query("p4_p10_clean_blocks", "SELECT book_id, page_no, CAST(chars % 5 AS BIGINT) AS block, count(*) AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rects WHERE cos(item_no % 4 * pi() / 2) > 0.99 AND abs(sin(item_no % 4 * pi() / 2)) < 0.05 GROUP BY ALL")
def p4_p10_clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.col("item_no") % 4 * F.pi() / 2
    level = page_rects(spark, sf_dir).where((F.cos(angle) > 0.99) & (F.abs(F.sin(angle)) < 0.05))
    return level.groupBy("book_id", "page_no", (F.col("chars") % 5).cast("long").alias("block")).agg(F.count("*").alias("lines"), *bounds())


@query("s4_s5_image_and_drawing_scans", "SELECT book_id, page_no, count(*) FILTER (WHERE kind = 'image') AS images, count(DISTINCT CASE WHEN kind = 'image' THEN digest END) AS digests, count(*) FILTER (WHERE kind = 'drawing') AS drawings FROM rects GROUP BY ALL")
def s4_s5_image_and_drawing_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return page_rects(spark, sf_dir).groupBy("book_id", "page_no").agg(F.count_if(kind == "image").alias("images"), F.countDistinct(F.when(kind == "image", F.col("digest"))).alias("digests"), F.count_if(kind == "drawing").alias("drawings"))


# Pictures of eight orders each: a line is a row of sixteen grey values, some pictures almost of one grey.
_GREY = "SELECT l_orderkey // 8 AS book_id, l_linenumber AS row_no, list_transform(range(16), lambda i: CAST(CASE WHEN l_orderkey // 8 % 3 = 0 THEN 200 + (l_partkey + i) % 9 ELSE (l_partkey * (i + 3) + l_suppkey) % 256 END AS INTEGER)) AS vals FROM lineitem"


@query("a17_flat_pictures", f", g AS ({_GREY}), v AS (SELECT book_id, unnest(vals) AS v FROM g), n AS (SELECT book_id, count(*) AS h FROM g GROUP BY ALL) SELECT book_id, coalesce(min(h) < 2 OR stddev_pop(v) < 8, true) AS flat FROM v JOIN n USING (book_id) GROUP BY book_id")
def a17_flat_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.expr("l_orderkey div 8")
    grey = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(book % 3 == 0, 200 + (F.col("l_partkey") + i) % 9).otherwise((F.col("l_partkey") * (i + 3) + F.col("l_suppkey")) % 256).cast("int"))
    return P.flat(table(spark, sf_dir, "lineitem").select(book.alias("book_id"), F.col("l_linenumber").alias("row_no"), grey.alias("values")), ["book_id"])


# Differences of pages: 48 rows of 100 pixels, changed in two spots that the page's numbers place.
_DIFF = "SELECT p.book_id, p.page_no, r.row_no, c.col, CASE WHEN (r.row_no + p.page_no) % 17 < 6 AND (c.col + p.book_id) % 41 < 15 THEN 30 ELSE (r.row_no * c.col) % 11 END AS d FROM (SELECT DISTINCT book_id, page_no FROM images) p, (SELECT unnest(range(48)) AS row_no) r, (SELECT unnest(range(100)) AS col) c"


@query("a18_visible_parts", f""", d AS (SELECT * FROM ({_DIFF}) WHERE d > 10),
i AS (SELECT *, greatest(0, CAST(trunc(x0 * 48 / 72) AS INTEGER)) AS px0, greatest(0, CAST(trunc(y0 * 48 / 72) AS INTEGER)) AS py0, CAST(ceil(x1 * 48 / 72) AS INTEGER) AS px1, CAST(ceil(y1 * 48 / 72) AS INTEGER) AS py1 FROM images),
b AS (SELECT book_id, page_no, item_no, x0, y0, x1, y1, min(col) AS a, max(col) + 1 AS z, min(row_no) AS b, max(row_no) + 1 AS e FROM i JOIN d USING (book_id, page_no) WHERE row_no >= py0 AND row_no < py1 AND col >= px0 AND col < px1 GROUP BY ALL)
SELECT book_id, page_no, item_no, greatest(x0, a / (48 / 72) - 1) AS x0, greatest(y0, b / (48 / 72) - 1) AS y0, least(x1, z / (48 / 72) + 1) AS x1, least(y1, e / (48 / 72) + 1) AS y1 FROM b""")
def a18_visible_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _kind(spark, sf_dir, "image")
    page, keys = (0.0, 0.0, 612.0, 792.0), ["book_id", "page_no"]
    rows = P.reached(images, page, 48, keys)
    changed = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda c: F.when(((F.col("row_no") + F.col("page_no")) % 17 < 6) & ((c + F.col("book_id")) % 41 < 15), 30).otherwise(F.col("row_no") * c % 11).cast("int"))
    return P.visible(images, rows.withColumn("values", changed), page, keys)


@query("j20_resource_names", "SELECT t.book_id, t.page_no, t.item_no, n.name FROM (SELECT *, chars % 50 AS xref FROM images) t LEFT JOIN (SELECT book_id, page_no, chars % 50 AS xref, arg_min('Im' || item_no, item_no) AS name FROM texts GROUP BY ALL) n USING (book_id, page_no, xref)")
def j20_resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    xref = (F.col("chars") % 50).alias("xref")
    resources = _kind(spark, sf_dir, "text").select("book_id", "page_no", F.col("item_no").alias("ord"), xref, F.concat(F.lit("Im"), F.col("item_no").cast("string")).alias("name"))
    return P.named(_kind(spark, sf_dir, "image").withColumn("xref", xref), resources, ["book_id", "page_no"]).select("book_id", "page_no", "item_no", "name")
