"""Column forms of journal functions: Arrow functions over text columns, and journals as JSON by native functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import references
from leafwork.functions.references import LEAST_NAME
from leafwork.functions.scan import Automaton
from leafwork.operators.journal import CORE_VERSION
from leafwork.operators.ordering import first_disjoint, splice
from leafwork.storage import saved


#: Tasks for each core, for work on rows that costs more than its bytes.
SPREAD = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over the cluster by keys: a small file is read by one task, which would do all work on its rows."""
    return rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def text_function(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of a text as a column function over Arrow batches; nulls stay null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


def linked_text(find: Callable[[str], list], openers: Callable[[], Automaton] | None = None) -> Callable[[Column], Column]:
    """Texts with the replacements that ``find`` gives; with openers only texts that hold one are searched, the others never reach Python's loop."""
    from leafwork.operators.journal import splice

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = texts.dropna()
        if openers is not None and len(own):
            own = own[openers().opened(own.tolist())]
        out = texts.copy()
        out[own.index] = [splice(t, find(t)) for t in own]
        return out

    return run


def mentioned(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """What may be references in texts (all columns kept): kind, start, end (from 0), number."""
    kept = texts.columns
    schema = T.StructType([*texts.schema, *T._parse_datatype_string("kind string, start int, end int, number int")])

    def run(batches):
        for b in batches:
            said = b.column(kept.index(text_col)).to_pylist()
            where = [i for i, t in enumerate(said) if t]
            hold = np.flatnonzero(references.openers().opened([said[i] for i in where])) if where else ()
            found = [(where[k], *m) for k in hold for m in references.mentions(said[where[k]])]
            row, *columns = zip(*found, strict=True) if found else ([], [], [], [], [])
            yield pa.record_batch([*b.take(pa.array(row, pa.int64())).columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True))], names=schema.names)

    return texts.mapInArrow(run, schema)


def linked_references(texts: DataFrame, names: DataFrame, pdf_pages: DataFrame, printed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Texts (doc, text_id, text) with links to chapters, pages and headings of their own document.

    names are titles and headings (doc, ord, name, target), pdf_pages (doc, pdf_page, ord, page_id) and printed
    (doc, printed, pdf_page). Each mention meets its targets in joins, so no document is one task's: chapters and
    pages by number, headings by those of its own starts that are as long as some heading of the document.
    """
    seen = mentioned(texts.select(doc, "text_id", "text"))  # written once, as three joins read it
    seen = saved(seen.withColumn("ref_id", F.concat_ws(":", "kind", F.col("start").cast("string"))), "mentions")
    chapters = seen.where("kind = 'chapter'").join(chapter_targets(names, doc).withColumnRenamed("n", "number"), [doc, "number"])
    pages = page_targets(seen.where("kind = 'page'").withColumnRenamed("number", "printed"), printed, pdf_pages, doc, ("text_id", "kind", "start", "end", "text"))
    pages = pages.withColumn("target", F.concat(F.lit("."), F.col("page_id")))
    headings = longest_heading(seen.where("kind = 'see'").withColumn("rest", F.expr("substring(text, start + 1)")), unique_headings(names, doc), doc, ("text_id", "kind", "start", "text"))
    headings = headings.withColumn("end", F.col("start") + F.col("n"))
    order = F.expr("CASE kind WHEN 'chapter' THEN 0 WHEN 'page' THEN 1 ELSE 2 END").alias("o")
    rep = F.concat(F.lit("@UUID["), F.col("target"), F.lit("]{"), F.replace(F.expr("substring(text, start + 1, end - start)"), F.lit("}"), F.lit(")")), F.lit("}"))
    span = F.struct(order, F.col("start").alias("s"), F.col("end").alias("e"), rep.alias("rep"))
    every = [x.select(doc, "text_id", span.alias("x")) for x in (chapters, pages, headings)]
    by_text = every[0].unionByName(every[1]).unionByName(every[2]).groupBy(doc, "text_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return texts.join(by_text, [doc, "text_id"], "left").withColumn("text", F.when(F.col("xs").isNull(), F.col("text")).otherwise(splice(F.col("text"), first_disjoint(F.col("xs"))))).drop("xs")


def page_ids(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds id (from the document and the page's place, so that runs repeat) and sort key."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy("ord")).cast("long")  # a long: 21,475 pages are too many for sort keys of an int
    own = pages.withColumn("sort", n * 100000)
    return own.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", F.col(doc).cast("string"), (n - 1).cast("string")), 256), 1, 16))


def journals(pages: DataFrame, now_ms: int = 0, doc: str = "doc_id") -> DataFrame:
    """By document its journal as JSON and as a macro, and its preview: pages have doc, ord, name, title, html."""
    stats = F.struct(F.lit(CORE_VERSION).alias("coreVersion"), F.lit(now_ms).alias("createdTime"), F.lit(now_ms).alias("modifiedTime"))
    page = F.struct(
        F.col("id").alias("_id"), F.col("title").alias("name"), F.lit("text").alias("type"), F.struct(F.lit(True).alias("show"), F.lit(1).alias("level")).alias("title"),
        F.struct(F.col("html").alias("content"), F.lit(1).alias("format")).alias("text"), F.col("sort"), F.struct(F.lit(-1).alias("default")).alias("ownership"), stats.alias("_stats"),
    )
    drawn = F.concat(F.lit("<article><h1>"), escape(F.col("title")), F.lit("</h1>"), preview_links(F.col("html")), F.lit("</article>"))
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    # Pages are written before they are gathered, and what isn't asked for is never gathered.
    in_order = lambda c, between: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort", c.alias("t")))), lambda p: p.t), between)
    own = page_ids(pages, doc).groupBy(doc).agg(F.first("name").alias("name"), in_order(as_json(page), ",").alias("ps"), in_order(drawn, "").alias("preview"))
    head = F.concat(F.regexp_replace(as_json(F.struct("name")), r"\}$", ',"pages":['), F.col("ps"), F.lit('],"folder":null,"sort":0,"ownership":{"default":0}'))
    entry = F.concat(head, F.lit(',"_stats":'), as_json(stats), F.lit("}"))
    macro = F.concat(F.lit("const data = "), head, F.lit("};\nconst entry = await JournalEntry.create(data);\nentry?.sheet.render(true);\n"))
    return own.select(doc, entry.alias("entry"), macro.alias("macro"), "preview")


def escape(c: Column) -> Column:
    from leafwork.functions.text import escape_html

    return escape_html(c, quotes=True)


def preview_links(c: Column) -> Column:
    """Links of both kinds shown as labelled spans."""
    c = F.regexp_replace(c, r"@coc7\.(\w+)\[([^\]]*)\]\{([^}]*)\}", '<span class="roll" title="@coc7.$1[$2]">🎲 $3</span>')
    return F.regexp_replace(c, r"@UUID\[([^\]]*)\]\{([^}]*)\}", '<span class="link" title="@UUID[$1]">📄 $2</span>')


def unique_headings(names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Names (doc, ord, name, target) that one place has, of four characters or more: key, target."""
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))), r"\s+", " ")
    own = names.withColumn("key", key).groupBy(doc, "key").agg(F.count("*").alias("n"), F.min(F.struct("ord", "target")).alias("t"))
    return own.where((F.col("n") == 1) & (F.char_length("key") >= LEAST_NAME)).select(doc, "key", F.col("t.target").alias("target"))


def longest_heading(refs: DataFrame, headings: DataFrame, doc: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """For each reference (doc, ref_id, rest: the text after ``see``) the longest heading it starts with; with more columns kept, also its length n."""
    # Headings that begin alike have few distinct lengths: each reference meets headings by its starts of those lengths.
    begin = lambda c: F.left(c, F.lit(LEAST_NAME))
    lengths = headings.select(doc, begin(F.col("key")).alias("_begin"), F.char_length("key").alias("n")).distinct()
    starts = refs.withColumn("_begin", begin(F.lower("rest"))).join(lengths, [doc, "_begin"]).select(doc, "ref_id", *more, "n", F.substring(F.lower("rest"), F.lit(1), F.col("n")).alias("key"), F.substring(F.lower("rest"), F.col("n") + 1, F.lit(1)).alias("then"))
    hits = starts.where(~F.col("then").rlike(r"^[\p{L}\p{N}]")).join(headings, [doc, "key"])
    best = hits.groupBy(doc, "ref_id", *more).agg(F.max(F.struct("n", "target")).alias("m"))
    return best.select(doc, "ref_id", *more, *([F.col("m.n").alias("n")] if more else []), F.col("m.target").alias("target"))


def page_targets(refs: DataFrame, printed: DataFrame, pdf_pages: DataFrame, doc: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """References by printed number resolved to journal pages: printed to PDF page, then to the first page that has it."""
    first = pdf_pages.groupBy(doc, "pdf_page").agg(F.min(F.struct("ord", "page_id")).alias("f")).select(doc, "pdf_page", F.col("f.page_id").alias("page_id"))
    return refs.join(printed, [doc, "printed"]).join(first, [doc, "pdf_page"]).select(doc, "ref_id", *more, "page_id")


def chapter_targets(names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chapters by number: the first name of a number has it."""
    from leafwork.functions.text import chapter_number

    n = chapter_number(F.regexp_extract("name", r"(?iu)^\s*(?:cap[ií]tulo|chapter)\s+(\w+)", 1))
    own = names.withColumn("n", n).where("n is not null").groupBy(doc, "n").agg(F.min(F.struct("ord", "target")).alias("t"))
    return own.select(doc, "n", F.col("t.target").alias("target"))
