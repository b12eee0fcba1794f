"""Running heads, feet and repeated titles: lines that stand at the same place on many pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import text as T

MARGIN_SHARE, BODY_SHARE, BODY_SPREAD = 0.25, 0.5, 0.02


def find_furniture(lines: DataFrame, doc: str = "book_id") -> DataFrame:
    """Furniture of each document: key, y (upper median), margin, first (page), pages.

    lines: doc, page_no, line_no, text, y_frac, in_margin. Margin lines are keyed with digits
    blanked and need a quarter of the pages (two at least); others are keyed exactly, and need half
    of them (three at least) at one height. Documents of one page have none.
    """
    n_pages = lines.groupBy(doc).agg(F.countDistinct("page_no").alias("n_pages")).where("n_pages >= 2")
    own = lines.where(F.char_length(T.strip(F.col("text"))).between(2, 120))
    own = own.withColumn("key", F.when(F.col("in_margin"), T.furniture_key(F.col("text"))).otherwise(F.concat(F.lit("="), T.exact_key(F.col("text")))))
    # the first line of a key on a page stands for it: a partial aggregate, not a window
    per_page = own.groupBy(doc, "key", "page_no").agg(F.min(F.struct("line_no", "y_frac", "in_margin")).alias("f"))
    groups = per_page.groupBy(doc, "key").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list("f.y_frac")).alias("ys"), F.every("f.in_margin").alias("margin"), F.min("page_no").alias("first"))
    groups = groups.join(n_pages, doc)
    often = lambda share, least: F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share))
    in_margin = F.col("margin") & often(MARGIN_SHARE, 2)
    in_body = often(BODY_SHARE, 3) & (F.element_at("ys", -1) - F.get("ys", F.lit(0)) <= BODY_SPREAD)
    found = groups.where(in_margin | in_body).withColumn("margin", in_margin)
    return found.select(doc, "key", F.get("ys", F.floor(F.size("ys") / 2).cast("int")).alias("y"), "margin", "first", F.col("pages").cast("long").alias("pages"))


def mark_furniture(lines: DataFrame, furniture: DataFrame, doc: str = "book_id") -> DataFrame:
    """The lines with ``is_furniture``: page numbers in margins, and lines that match an entry.

    A margin line is looked up by its blanked key, then by its exact one; an entry of the body keeps
    its first page, and matches within 3 % of its height.
    """
    entry = lambda p: furniture.select(doc, F.col("key").alias(f"{p}key"), F.struct("y", "margin", "first").alias(f"{p}e"))
    keyed = lines.withColumns({"mkey": F.when(F.col("in_margin"), T.furniture_key(F.col("text"))), "xkey": F.concat(F.lit("="), T.exact_key(F.col("text")))})
    joined = keyed.join(entry("m"), [doc, "mkey"], "left").join(entry("x"), [doc, "xkey"], "left").withColumn("e", F.coalesce("me", "xe"))
    near = F.abs(F.col("y_frac") - F.col("e.y")) <= 0.03
    hit = F.when(F.col("e.margin"), F.col("in_margin") | near).otherwise((F.col("page_no") != F.col("e.first")) & near)
    number = F.col("in_margin") & T.is_page_number(F.col("text"))
    return joined.withColumn("is_furniture", number | F.coalesce(hit, F.lit(False))).drop("mkey", "xkey", "me", "xe", "e")


def printed_pages(lines: DataFrame, doc: str = "book_id", order: str = "page_no") -> DataFrame:
    """Printed page numbers in margins: printed, pdf_page (from 1); the first page with a number has it."""
    own = lines.where(F.col("in_margin") & T.strip(F.col("text")).rlike("^[0-9]{1,4}$"))
    first = own.groupBy(doc, T.strip(F.col("text")).cast("int").alias("printed")).agg(F.min(F.struct(F.col(order).alias("at"), "page_no")).alias("f"))
    return first.select(doc, "printed", (F.col("f.page_no") + 1).alias("pdf_page"))


def repeated_images(images: DataFrame, doc: str = "book_id", n_pages: DataFrame | None = None) -> DataFrame:
    """Digests on three pages or more, or on two that are half of the document's: digest, pages."""
    n_pages = n_pages if n_pages is not None else images.groupBy(doc).agg(F.countDistinct("page_no").alias("n_pages"))
    seen = images.where("digest is not null").groupBy(doc, "digest").agg(F.countDistinct("page_no").alias("pages"))
    return seen.join(n_pages, doc).where((F.col("pages") >= 3) | ((F.col("pages") >= 2) & (F.col("pages") >= 0.5 * F.col("n_pages")))).select(doc, "digest", "pages")
