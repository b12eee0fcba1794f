"""Queries of scalar functions over strings made from the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import pages as P
from leafwork.functions import stats as S
from leafwork.functions import text as T
from leafwork.functions.glyphs import without_glyphs
from leafwork.operators.frames import spread
from leafwork.sources.layout import LINES_SQL, book_lines, table
from leafwork.storage import saved

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("p1_parse_pages", """WITH s AS (SELECT o_orderkey, 20 AS n, o_orderkey % 5 + 1 AS a, o_orderkey % 7 + 6 AS b, o_orderkey % 20 + 1 AS c FROM orders),
l AS (SELECT o_orderkey, range(a - 1, b) || [c - 1] || range(17, 20) AS ps FROM s), u AS (SELECT o_orderkey, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM l),
f AS (SELECT o_orderkey, p, min(i) AS i FROM u GROUP BY ALL) SELECT o_orderkey, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY i) AS pages FROM f GROUP BY o_orderkey""")
def p1_parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    spec = F.concat((k % 5 + 1).cast("string"), F.lit("-"), (k % 7 + 6).cast("string"), F.lit(", "), (k % 20 + 1).cast("string"), F.lit(",,18-"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(P.parse_pages(spec, F.lit(20)), " ").alias("pages"))


@query("p2_format_pages", """WITH p AS (SELECT DISTINCT l_orderkey // 2 AS k, CAST((l_orderkey % 2) * 5 + l_linenumber AS INTEGER) AS p FROM lineitem WHERE l_quantity > 15),
i AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM p), r AS (SELECT k, min(p) AS a, max(p) AS b FROM i GROUP BY k, g)
SELECT k, string_agg(CASE WHEN a = b THEN CAST(a + 1 AS VARCHAR) ELSE (a + 1) || '-' || (b + 1) END, ',' ORDER BY a) AS spec FROM r GROUP BY k""")
def p2_format_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").where("l_quantity > 15").select(F.expr("l_orderkey div 2").alias("k"), ((F.col("l_orderkey") % 2) * 5 + F.col("l_linenumber")).cast("int").alias("page_no"))
    return P.format_pages(own, "k")


@query("p3_keep_pages", "SELECT o_orderkey, CAST(coalesce(list_sum(list_filter([o_orderkey % 9 - 3, o_orderkey % 7, o_orderkey % 13], lambda p: p >= 0 AND p < 8)), 0) AS BIGINT) AS total, len(list_filter([o_orderkey % 9 - 3, o_orderkey % 7, o_orderkey % 13], lambda p: p >= 0 AND p < 8)) AS n FROM orders")
def p3_keep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kept = P.keep_pages(F.array(k % 9 - 3, k % 7, k % 13), F.lit(8))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(kept).cast("long").alias("n"))


_W = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query("f2_f3_f4_keys", f"WITH {LINES_SQL} SELECT book_id, page_no, line_no, regexp_replace({_W.format('lower(text)')}, '[0-9]+', '#', 'g') AS fkey, {_W.format('lower(text)')} AS xkey FROM lines")
def f2_f3_f4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return book_lines(spark, sf_dir).select("book_id", "page_no", "line_no", T.furniture_key(t).alias("fkey"), T.exact_key(t).alias("xkey"))


@query("f1_round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_tax * 10 * 2 + l_quantity / 4 * 2, 0) / 2 AS half FROM lineitem")
def f1_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_tax") * 10 * 2 + F.col("l_quantity") / 4 * 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.rint(x) / 2).alias("half"))


@query("f5_slugify", f"WITH {LINES_SQL} SELECT book_id, page_no, line_no, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(replace(text, 'ß', '')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'journal') AS slug FROM lines")
def f5_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_lines(spark, sf_dir).select("book_id", "page_no", "line_no", T.slugify(F.col("text")).alias("slug"))


@query("f6_heading_anchor", f"WITH {LINES_SQL} SELECT book_id, page_no, line_no, substring(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', '-', 'g'), '[\"'']', '', 'g'), 1, 64) AS anchor FROM lines")
def f6_heading_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_lines(spark, sf_dir).select("book_id", "page_no", "line_no", T.heading_anchor(F.col("text")).alias("anchor"))


# Numerals of all numbers to 150 in Roman letters, in digits and by words, of either case, and words that are none.
_NUMERALS = """nm AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN repeat('C', k // 100) || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][k // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][k % 10 + 1]
  WHEN 1 THEN ' ' || k || ' ' WHEN 2 THEN ['One', 'dois', 'três', 'FOUR', 'cinco', 'six', 'Sete', 'eight', 'nove', 'ten', 'onze', 'Doze', 'treze', 'zero'][k % 14 + 1] ELSE repeat('I', k % 5) || 'xx' || substring(o_orderpriority, 3, k % 3) END AS n FROM (SELECT *, CAST(o_orderkey // 4 % 150 + 1 AS INTEGER) AS k FROM orders))"""
_VALUE = """CASE WHEN regexp_full_match(trim(n), '[0-9]+') THEN CAST(trim(n) AS INTEGER)
  WHEN regexp_full_match(upper(trim(n)), '[IVXLC]+') THEN CAST(list_sum(list_transform(range(1, length(trim(n)) + 1), lambda i: v(upper(trim(n))[i]) * CASE WHEN coalesce(v(upper(trim(n))[i + 1]), 0) > v(upper(trim(n))[i]) THEN -1 ELSE 1 END)) AS INTEGER)
  ELSE CAST(list_position(['um', 'dois', 'tres', 'quatro', 'cinco', 'seis', 'sete', 'oito', 'nove', 'dez', 'onze', 'doze'], replace(lower(trim(n)), 'ê', 'e')) + list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'], lower(trim(n))) AS INTEGER) END"""
_WORTH = "CASE {0} WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 END"


def _value_sql() -> str:
    import re

    sql = _VALUE.replace("list_position(['um'", "coalesce(list_position(['um'").replace("'ê', 'e')) + ", "'ê', 'e')), ").replace("lower(trim(n))) AS INTEGER) END", "lower(trim(n)))) AS INTEGER) END")
    return re.sub(r"v\((upper\(trim\(n\)\)\[[^\]]+\])\)", lambda m: f"({_WORTH.format(m[1])})", sql)


@query("f7_chapter_number", f"WITH {_NUMERALS} SELECT o_orderkey, n, {_value_sql()} AS value FROM nm")
def f7_chapter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    k = (F.expr("o_orderkey div 4") % 150 + 1).cast("int")
    tens, ones = (F.array(*map(F.lit, x.split(","))) for x in (",X,XX,XXX,XL,L,LX,LXX,LXXX,XC", ",I,II,III,IV,V,VI,VII,VIII,IX"))
    words = F.array(*map(F.lit, "One,dois,três,FOUR,cinco,six,Sete,eight,nove,ten,onze,Doze,treze,zero".split(",")))
    roman = F.concat(F.when(k >= 100, "C").otherwise(""), F.get(tens, (k / 10).cast("int") % 10), F.get(ones, k % 10))
    other = F.concat(F.repeat(F.lit("I"), k % 5), F.lit("xx"), F.substring(F.col("o_orderpriority"), F.lit(3), k % 3))
    n = F.when(key % 4 == 0, roman).when(key % 4 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(key % 4 == 2, F.get(words, k % 14)).otherwise(other)
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), T.chapter_number(n).alias("value"))


@query("f23_escape", f"WITH {LINES_SQL} SELECT book_id, page_no, line_no, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM lines")
def f23_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_lines(spark, sf_dir).select("book_id", "page_no", "line_no", T.escape_html(F.col("text")).alias("html"))


@query("p12_clean_cell", "SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(c, chr(173), ''), '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '  ' || replace(p_name, ' ', '-' || chr(10)) || chr(173) || chr(10) || ' ' || p_type || ' ' END AS c FROM part)")
def p12_clean_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("-\n")), F.lit("­\n "), F.col("p_type"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_cell(cell).alias("cell"))


_STAT = "'FOR ' || p_size || ' CON: ' || (p_size + 5) || ' TAM ' || (p_size % 9) || ' DES ' || (p_partkey % 90) || CASE WHEN p_partkey % 3 = 0 THEN ' INT 50 POD 60 EDU 70' WHEN p_partkey % 3 = 1 THEN ' and then ' || p_name || ' was here again and again' ELSE '' END"


@query("f15_f16_a10_stat_lines", f"""WITH t AS (SELECT p_partkey, p_size, {_STAT} AS t FROM part),
r AS (SELECT p_partkey, p_partkey % 3 AS m, [['FOR', CAST(p_size AS VARCHAR)], ['CON', CAST(p_size + 5 AS VARCHAR)], ['TAM', CAST(p_size % 9 AS VARCHAR)], ['DES', CAST(p_partkey % 90 AS VARCHAR)]] || CASE WHEN p_partkey % 3 = 0 THEN [['INT', '50'], ['POD', '60'], ['EDU', '70']] ELSE [] END AS ps FROM t)
SELECT p_partkey, CASE WHEN m = 0 THEN array_to_string([x[1] for x in ps[1:4]], '|') || '/' || array_to_string([x[2] for x in ps[1:4]], '|') || '/' || array_to_string([x[1] for x in ps[5:7]], '|') || '|/' || array_to_string([x[2] for x in ps[5:7]], '|') || '|'
  ELSE array_to_string([x[1] for x in ps], '|') || '/' || array_to_string([x[2] for x in ps], '|') END AS tab FROM r WHERE m <> 1""")
def f15_f16_a10_stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = saved(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey"), "part")  # a filter goes below a shuffle, not below a table
    rows = part.select("p_partkey", S.stat_table(F.expr(_STAT)).alias("rows")).where("rows is not null")
    return rows.select("p_partkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("tab"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    stat = F.array(F.array(F.lit("FOR"), size, F.lit(""), F.lit("CON"), F.lit("3")), F.array(F.lit("TAM"), size, F.lit(""), F.lit("DES"), F.lit("5")))
    plain = F.array(F.array(F.lit("Roll"), F.lit(""), F.lit("Name")), F.array(size, F.lit(""), F.col("p_name")), F.array((F.col("p_size") + 1).cast("string"), F.lit(""), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(key % 2 == 0, stat).otherwise(plain).alias("rows"))


@query("f17_stat_grid", "SELECT p_partkey, 'FOR|CON/' || p_size || '|3/TAM|DES/' || p_size || '|5' AS tab FROM part WHERE p_partkey % 2 = 0")
def f17_stat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir).select("p_partkey", S.stat_grid(F.col("rows")).alias("rows")).where("rows is not null")
    return rows.select("p_partkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("tab"))


@query("p23_f18_grid_header", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'Roll|Name/' || p_size || '|' || p_name || '/' || (p_size + 1) || '|' || p_brand ELSE 'FOR|' || p_size || '|CON|3/TAM|' || p_size || '|DES|5' END AS tab, p_partkey % 2 = 1 AS header FROM part")
def p23_f18_grid_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir).select("p_partkey", S.drop_empty_columns(F.col("rows")).alias("rows"))
    return rows.select("p_partkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("tab"), S.has_header(F.col("rows"), F.lit(False), F.lit(False)).alias("header"))


@query("p11_s3_ruled_tables", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND length(p_name) <= 250 AND 4 - CAST(p_size % 2 = 0 AS INTEGER) - CAST(p_size % 5 = 0 AS INTEGER) >= 3")
def p11_s3_ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    a, b = F.when(size % 2 == 0, "").otherwise("x"), F.when(size % 5 == 0, "").otherwise("y")
    rows = F.when(size % 3 == 0, F.array(F.array(name, a))).otherwise(F.array(F.array(name, a), F.array(b, F.lit("z"))))
    return table(spark, sf_dir, "part").where(S.ruled_table(rows)).select("p_partkey")


@query("p16_row_candidates", "SELECT c_custkey FROM customer WHERE length(c_name) <= 160 AND least(length(c_name), length(c_mktsegment)) <= 30 AND c_custkey % 4 <> 0")
def p16_row_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.when(F.col("c_custkey") % 4 == 0, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment"))
    return table(spark, sf_dir, "customer").where(S.is_row_candidate(cells)).select("c_custkey")


@query("p8_p9_glyphs", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '• ' || p_name WHEN 1 THEN NULL WHEN 2 THEN p_name || ' — x' WHEN 3 THEN '• ' || p_name ELSE p_name END AS text FROM part""")
def p8_p9_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda t, f="Serif": F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(f).alias("font"))
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    spans = F.when(k == 0, F.array(span("l", "Wingdings"), span(name))).when(k == 1, F.array(span("* * *"))).when(k == 2, F.array(span(name), span(" — x")))
    spans = spans.when(k == 3, F.array(span(F.concat(F.lit("❖ "), name)))).otherwise(F.array(span(F.concat(name, F.lit("�")))))
    left = without_glyphs(spans)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(left, lambda s: s.text), "").alias("text"))


@query("s6_p24_default_name", """SELECT p_partkey, CASE WHEN title IS NULL OR trim(title) = '' THEN 'file-' || p_partkey WHEN lower(trim(title)) IN ('untitled', 'sem título', 'document', 'documento') THEN 'file-' || p_partkey ELSE trim(title) END AS name
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Untitled' WHEN 1 THEN ' ' WHEN 2 THEN 'Sem Título' ELSE ' ' || p_name END AS title FROM part)""")
def s6_p24_default_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.plans.convert import display_name

    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, "Untitled").when(k % 4 == 1, " ").when(k % 4 == 2, "Sem Título").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", display_name(F.lit(None).cast("string"), title, F.concat(F.lit("file-"), k.cast("string"))).alias("name"))


@query("f28_image_widths_f29_paths", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity * 96 / 72.0, 0) AS INTEGER) AS width, CASE WHEN l_linenumber % 2 = 0 THEN 'worlds/w/' ELSE 'slug' END || '/' || l_linenumber || '.webp' AS src FROM (SELECT * REPLACE (CAST(l_quantity AS DOUBLE) AS l_quantity) FROM lineitem)")
def f28_image_widths_f29_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.concat_ws("/", F.when(F.col("l_linenumber") % 2 == 0, "worlds/w/").otherwise("slug"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".webp")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.rint(F.col("l_quantity") * 96 / 72).cast("int").alias("width"), src.alias("src"))


@query("u4_selection_difference", "SELECT o_orderkey, array_to_string(list_sort(list_distinct([x for x in [1, 2, 3, o_orderkey % 5] if x NOT IN (o_orderkey % 3, o_orderkey % 4)])), ',') AS d FROM orders")
def u4_selection_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = F.array_except(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), k % 5), F.array(k % 3, k % 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(d), ",").alias("d"))


@query("p21_s14_destinations", """SELECT o_orderkey, CASE WHEN ok THEN CASE WHEN world <> '' AND data <> '' THEN data || '/worlds/' || world || '/leafwork' WHEN o_custkey % 2 = 0 THEN 'out/' || o_custkey ELSE '.' END END AS folder,
  CASE WHEN ok THEN CASE WHEN world = '' THEN 'leafwork/' ELSE 'worlds/' || world || '/leafwork/' END || 'book-' || o_orderkey END AS prefix, ok AS allowed
FROM (SELECT *, NOT contains(world, ' ') AND NOT contains(world, '/') AS ok FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'World.' || o_custkey WHEN 2 THEN 'no world ' || o_custkey WHEN 3 THEN 'a/' || o_custkey ELSE 'mundo-É_' || o_custkey END AS world, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/data/' || o_orderkey % 7 END AS data FROM orders))""")
def p21_s14_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafwork.sources.worlds import destinations

    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    world = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("World."), c)).when(k % 5 == 2, F.concat(F.lit("no world "), c)).when(k % 5 == 3, F.concat(F.lit("a/"), c)).otherwise(F.concat(F.lit("mundo-É_"), c))
    data = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/data/"), (k % 7).cast("string")))
    out = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("out/"), c))
    folder, prefix, allowed = destinations(F.concat(F.lit("book-"), k.cast("string")), out, world, data)
    return table(spark, sf_dir, "orders").select("o_orderkey", folder.alias("folder"), prefix.alias("prefix"), allowed.alias("allowed"))
