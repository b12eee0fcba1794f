"""Page selections: specifications such as ``1-3,7,10-`` and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_pages(spec: Column, count: Column) -> Column:
    """0-based pages of a specification, each once in order of first mention; a blank one means all.

    Parts are n, a-b, a-, -b or -; an invalid part, or one beyond the document, is an error.
    """
    parts = F.filter(F.split(F.replace(F.coalesce(spec, F.lit("")), F.lit(" "), F.lit("")), ","), lambda p: p != "")

    def pages(p: Column) -> Column:
        a = F.coalesce(F.nullif(F.regexp_extract(p, "^([0-9]*)", 1), F.lit("")).cast("int"), F.lit(1))
        b = F.when(F.contains(p, F.lit("-")), F.coalesce(F.nullif(F.regexp_extract(p, "-([0-9]*)$", 1), F.lit("")).cast("int"), count)).otherwise(a)
        bad = F.raise_error(F.concat(F.lit("invalid pages: "), p)).cast("array<int>")
        return F.when(~p.rlike("^([0-9]*-[0-9]*|[0-9]+)$"), bad).when((a < 1) | (b > count) | (a > b), bad).otherwise(F.sequence(a - 1, b - 1))

    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.trim(F.coalesce(spec, F.lit(""))) == "", every).otherwise(F.array_distinct(F.flatten(F.transform(parts, pages))))


def keep_pages(selected: Column, count: Column) -> Column:
    """The pages of a list that the document has; others are dropped silently."""
    return F.filter(selected, lambda p: (p >= 0) & (p < count))


def format_pages(pages: DataFrame, key: str, page: str = "page_no") -> DataFrame:
    """By key the specification of its set of 0-based pages: runs by gaps and islands."""
    own = pages.select(key, F.col(page).alias("p")).distinct()
    own = own.withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p")))
    runs = own.groupBy(key, "island").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat((F.col("a") + 1).cast("string"), F.lit("-"), (F.col("b") + 1).cast("string")))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x.t), ",").alias("spec"))
