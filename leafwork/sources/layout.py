"""Layout tables: the schemas the engine works on, and synthetic layouts over the driver's tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the physical tables; every ordinal is explicit, as row order means nothing.
SCHEMAS = {
    "docs": "doc_id string, title string, n_pages int",
    "pages": "doc_id string, page_no int, sel_ord int, x0 double, y0 double, x1 double, y1 double",
    "spans": "doc_id string, page_no int, block_no int, line_no int, span_no int, text string, font string, size double, flags int, "
    "dir_x double, dir_y double, x0 double, y0 double, x1 double, y1 double, lx0 double, ly0 double, lx1 double, ly1 double",
    "grid_tables": "doc_id string, page_no int, table_no int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>",
    "image_infos": "doc_id string, page_no int, image_no int, digest string, xref int, x0 double, y0 double, x1 double, y1 double",
    "drawings": "doc_id string, page_no int, drawing_no int, x0 double, y0 double, x1 double, y1 double, fill array<double>, color array<double>, item_ops array<string>",
}


class LayoutError(ValueError):
    """A layout that can't be used, told in words for the user."""


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A layout table kept as Parquet under a folder; one that is absent or can't be read is told in words."""
    at = f"{path.rstrip('/')}/{name}.parquet"
    try:
        found = spark.read.parquet(at).columns
    except AnalysisException as error:
        absent = "PATH_NOT_FOUND" in str(error)
        raise LayoutError(f"no table {name} at {at}" if absent else f"{at} can't be read as Parquet") from error
    except Exception as error:
        raise LayoutError(f"{at} can't be read as Parquet") from error
    lacking = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMAS[name]) if c.split()[0] not in found]
    if lacking:
        raise LayoutError(f"{at} lacks {', '.join(lacking)}")
    return spark.read.schema(SCHEMAS[name]).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAGE = (0.0, 0.0, 612.0, 792.0)
#: Bytes of a table's files whose rows are one task's.
TASK_BYTES = 2 << 20


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to tasks whose number follows the size of the files they come from.

    So what a task sorts stays the same as tables grow, and all that is grouped by these and further keys stays where it is.
    """
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES), *keys)


def book_lines(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Lines of books: ten documents make a book, one is a page, its lines are the page's.

    Places, sizes and weights follow from the ordinals, in multiples of a quarter. ``together``: books are dealt as
    wholes before texts are split, for work that sorts lines again and again and adds up few.
    """
    source = table(spark, sf_dir, "documents")
    docs = source.select(F.expr("doc_id div 10").alias("book_id"), (F.col("doc_id") % 10).cast("int").alias("page_no"), "text")
    docs = (dealt(docs, source, "book_id") if together else docs).withColumn("ls", F.split("text", "\n"))
    rows = docs.select("book_id", "page_no", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("line_no", "text"))
    no, w = F.col("line_no"), F.least(F.char_length("text"), F.lit(80)) * 5.5
    rows = rows.withColumns({
        "y_frac": (no + 0.5) / F.col("n_lines"),
        "x0": 54.0 + (no % 3) * 12.0,
        "y0": 36.0 + no * 12.0 + F.when(no % 9 == 8, 9.0).otherwise(0.0),
        "size": F.when((no == 0) & (F.col("book_id") % 3 != 1), 18.25).when(no % 7 == 3, 14.0).when(no % 11 == 5, 8.75).otherwise(10.0),
        "bold": no % 5 == 0,
    })
    return rows.withColumns({"x1": F.col("x0") + w, "y1": F.col("y0") + 10.0, "in_margin": (F.col("y_frac") < 0.12) | (F.col("y_frac") > 0.88)})


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, numbers and texts of the books' lines, each page's in order in one partition: documents are dealt and sorted before they are split."""
    source, keys = table(spark, sf_dir, "documents"), ["book_id", "page_no"]
    docs = source.select(F.expr("doc_id div 10").alias("book_id"), (F.col("doc_id") % 10).cast("int").alias("page_no"), "text")
    return dealt(docs, source, *keys).sortWithinPartitions(*keys).select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


LINES_SQL = r"""bl0 AS (SELECT doc_id // 10 AS book_id, CAST(doc_id % 10 AS INTEGER) AS page_no, string_split(text, chr(10)) AS ls FROM documents),
bl1 AS (SELECT book_id, page_no, len(ls) AS n_lines, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no FROM bl0),
bl2 AS (SELECT *, (CAST(line_no AS DOUBLE) + 0.5) / n_lines AS y_frac, CAST(54.0 + (line_no % 3) * 12.0 AS DOUBLE) AS x0,
    CAST(36.0 + line_no * 12.0 + CASE WHEN line_no % 9 = 8 THEN 9.0 ELSE 0.0 END AS DOUBLE) AS y0,
    CAST(CASE WHEN line_no = 0 AND book_id % 3 <> 1 THEN 18.25 WHEN line_no % 7 = 3 THEN 14.0 WHEN line_no % 11 = 5 THEN 8.75 ELSE 10.0 END AS DOUBLE) AS size,
    line_no % 5 = 0 AS bold FROM bl1),
lines AS (SELECT *, x0 + least(length(text), 80) * 5.5 AS x1, y0 + 10.0 AS y1, y_frac < 0.12 OR y_frac > 0.88 AS in_margin FROM bl2)"""


def words_of(lines: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The spans of ``word_spans`` for a batch of the books' lines: line, text, size, bold."""
    words = pc.split_pattern(lines.column("text"), " ")
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    line = np.repeat(np.arange(len(count)), count)
    no = np.arange(len(line)) - (np.cumsum(count) - count)[line]
    return line, words.flatten(), lines.column("size").to_numpy()[line] + np.where(no % 4 == 3, 2.25, 0.0), no % 6 != 5


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the books' lines: one for each word, every fourth a little larger, places by position."""
    lines = book_lines(spark, sf_dir)
    rows = lines.select("book_id", "page_no", "line_no", F.col("size").alias("line_size"), "x0", "y0", F.posexplode(F.split("text", " ")).alias("span_no", "text"))
    no = F.col("span_no")
    return rows.select(
        "book_id", "page_no", "line_no", "span_no", "text", (F.col("line_size") + F.when(no % 4 == 3, 2.25).otherwise(0.0)).alias("size"), (no % 6 != 5).alias("bold"),
        (F.col("x0") + no * 40.0 + F.when(no % 5 == 4, 14.0).otherwise(0.0)).alias("x0"), (F.col("x0") + no * 40.0 + 38.0).alias("x1"), F.col("y0"), (F.col("y0") + 10.0).alias("y1"),
    )


SPANS_SQL = LINES_SQL + r""",
sp0 AS (SELECT book_id, page_no, line_no, size AS line_size, x0, y0, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS span_no FROM lines),
spans AS (SELECT book_id, page_no, line_no, span_no, text, line_size + CASE WHEN span_no % 4 = 3 THEN 2.25 ELSE 0.0 END AS size, span_no % 6 <> 5 AS bold,
    x0 + span_no * 40.0 + CASE WHEN span_no % 5 = 4 THEN 14.0 ELSE 0.0 END AS x0, x0 + span_no * 40.0 + 38.0 AS x1, y0, y0 + 10.0 AS y1 FROM sp0)"""


def page_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on pages, from lineitem: eight orders make a book, the line number is the page.

    kind: text, image, table or drawing; digest repeats over pages; chars is a text's length.
    """
    li = table(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") % 500).cast("double")
    y0 = (F.col("l_suppkey") * 37 % 700).cast("double")
    kind = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "R", "image").when(F.col("l_linestatus") == "O", "drawing").otherwise("table")
    rows = li.select(
        F.expr("l_orderkey div 8").alias("book_id"), F.col("l_linenumber").alias("page_no"), ((F.col("l_orderkey") % 8) * 1000 + F.col("l_partkey") % 1000).cast("int").alias("item_no"),
        kind.alias("kind"), F.concat(F.lit("d"), (F.col("l_suppkey") % 7).cast("string")).alias("digest"), (F.col("l_quantity") * 7).cast("int").alias("chars"),
        x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 5.0).alias("x1"), (y0 + 20.0 + (F.col("l_orderkey") % 13) * 24.0).alias("y1"), F.col("l_discount").alias("shade"),
    )
    return dealt(rows, li, "book_id").groupBy("book_id", "page_no", "item_no").agg(F.min(F.struct("kind", "digest", "chars", "x0", "y0", "x1", "y1", "shade")).alias("r")).select("book_id", "page_no", "item_no", "r.*")


RECTS_SQL = r"""re0 AS (SELECT l_orderkey // 8 AS book_id, l_linenumber AS page_no, CAST((l_orderkey % 8) * 1000 + l_partkey % 1000 AS INTEGER) AS item_no,
    CASE WHEN l_returnflag = 'A' THEN 'text' WHEN l_returnflag = 'R' THEN 'image' WHEN l_linestatus = 'O' THEN 'drawing' ELSE 'table' END AS kind,
    'd' || CAST(l_suppkey % 7 AS VARCHAR) AS digest, CAST(l_quantity * 7 AS INTEGER) AS chars, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 37 % 700 AS DOUBLE) AS y0,
    l_quantity * 5.0 AS w, CAST(20.0 + (l_orderkey % 13) * 24.0 AS DOUBLE) AS h, l_discount AS shade FROM lineitem),
rects AS (SELECT book_id, page_no, item_no, r.* FROM (SELECT book_id, page_no, item_no, min(struct_pack(kind := kind, digest := digest, chars := chars, x0 := x0, y0 := y0, x1 := x0 + w, y1 := y0 + h, shade := shade)) AS r FROM re0 GROUP BY ALL))"""
