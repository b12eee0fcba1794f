"""Lines into paragraphs, and pages into one stream, by window expressions: no row leaves the JVM.

Lines carry keys (document, page, block), an ordinal, text, dominant size (in halves), bold, and sides. A block's lines
are marked where a paragraph, item, heading or drop cap starts; running sums of marks number the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import stats
from leafwork.functions.text import strip

# Markers of lists, labels of sheets, ends of sentences.
MARKER = r"^(?U)(\s*[•●▪■◦○▸►–—*·-]\s+|\s*([0-9]{1,3}|[a-zA-Z])[.)]\s+)"
ORDERED = r"^(?U)\s*([0-9]{1,3}|[a-zA-Z])[.)]\s+"
LABELLED = r"^(?U)[A-ZÀ-Ý][\wÀ-ÿ%/()' -]{1,32}:\s*\S"
ENDS = r"""[.!?:…"”»)]$"""
TITLE_MOST, HEADING_MOST = 70, 200


def last(c: Column, n: int = 1) -> Column:
    """The last characters of a text: what ends it is told by them, without a search through long lines."""
    return F.right(c, F.lit(n))


def trimmed(c: Column, left: bool = True) -> Column:
    """The text without Unicode white space at its end, and at its start if told so; searched only where there is some."""
    edge = last(c).rlike(r"(?U)^\s") | (c.rlike(r"^(?U)\s") if left else F.lit(False))
    return F.when(edge, strip(c) if left else F.regexp_replace(c, r"(?U)\s+$", "")).otherwise(c)


def same_row(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Fragments at one height, each right of the one before, made one line: their texts, by place, and its bounds.

    What a line has grown to decides on the next fragment's height, so fragments are folded in order, a fold of the JVM
    over each run in which one stands right of the one before; most runs are one line. Gives keys, order (of the first fragment), parts (array of structs of the other
    columns) and x0, y0, x1, y1.
    """
    rest = [c for c in lines.columns if c not in (*keys, order)]
    held = F.array_sort(F.collect_list(F.struct(order, *rest)))
    line = lambda p: F.struct(p[order].alias(order), F.array(p).alias("parts"), *(p[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (p["x0"] >= last["x1"] - 1) & (F.abs(last["y0"] + last["y1"] - p["y0"] - p["y1"]) < 0.8 * F.greatest(F.lit(1.0), last["y1"] - last["y0"]))
        grown = F.struct(
            last[order].alias(order), F.concat(last["parts"], F.array(p)).alias("parts"), last["x0"].alias("x0"), F.least(last["y0"], p["y0"].cast("double")).alias("y0"),
            p["x1"].cast("double").alias("x1"), F.greatest(last["y1"], p["y1"].cast("double")).alias("y1"),
        )
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(line(p))))

    w = Window.partitionBy(*keys).orderBy(order)
    own = lines.withColumn("_right", F.coalesce(F.col("x0") < F.lag("x1").over(w) - 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_right").over(w))
    own = own.groupBy(*keys, "_run").agg(held.alias("_held"))
    first = F.array(line(F.element_at("_held", 1)))
    folded = F.aggregate(F.slice("_held", F.lit(2), F.greatest(F.size("_held") - 1, F.lit(0))), first, add)
    return own.select(*keys, F.explode(folded).alias("x")).select(*keys, "x.*")


def paragraphs(lines: DataFrame, keys: list[str], order: str, body: Column, level: Column) -> DataFrame:
    """Blocks of lines (text, size, bold, x0, y0, x1, y1): keys, ord, kind, lines, text; level is the heading level of a size, or null."""
    w, all_ = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    own = lines.withColumn("text", F.replace("text", F.lit("\xad"), F.lit(""))).withColumn("t", trimmed(F.col("text"))).where("t <> ''")
    letters = (F.char_length("t") <= 2) & F.col("t").rlike(r"^\p{L}+$")
    own = own.withColumns({
        "kind": F.when(letters & (F.col("size") >= 1.8 * body), "dropcap").when(level.isNotNull(), F.concat(F.lit("h"), level.cast("string"))).otherwise("p"),
        "mark": F.char_length(F.regexp_extract("text", MARKER, 0)), "lab": F.col("t").rlike(LABELLED), "cap": F.col("t").rlike(r"^[\p{Lu}\p{Nd}]"), "ends": last(F.col("t")).rlike(ENDS),
    })
    lag = lambda c: F.lag(c).over(w)
    n_labels = F.count_if("lab").over(all_)
    own = own.withColumns({
        "left": F.min("x0").over(all_), "right": F.max("x1").over(all_), "sheet": (n_labels >= 2) & (n_labels >= 0.4 * F.count("*").over(all_)),
        "hard": F.coalesce((lag("kind") != F.col("kind")) | (F.col("kind") == "dropcap") | (F.col("kind") == "p") & ((F.col("mark") > 0) | (F.col("y0") - lag("y1") > 0.7 * F.col("size"))), F.lit(True)),
        "before": lag("t"), "turned": lag("bold") & ~F.col("bold"), "two_labels": lag("lab") & F.col("lab"), "after_end": lag("ends"), "last_x1": lag("x1"),
    })
    short = F.col("after_end") & (F.col("last_x1") < F.col("right") - 3 * F.col("size"))
    plain = (F.col("x0") > F.col("left") + F.greatest(F.lit(6.0), 0.8 * F.col("size"))) | F.col("two_labels") | F.col("cap") & short
    looks = F.when(F.col("sheet"), F.col("cap") & ~last(F.col("before")).isin("-", ",", "(")).otherwise(plain)
    own = own.withColumns({"looks": F.coalesce(looks, F.lit(False)), "turns": F.coalesce(~F.col("sheet") & F.col("turned"), F.lit(False)), "seg": F.sum(F.col("hard").cast("int")).over(w)})
    own = own.withColumn("free", F.first((F.col("kind") == "p") & (F.col("mark") == 0)).over(Window.partitionBy(*keys, "seg").orderBy(order)))
    # a line that turns from bold follows a bold one, which doesn't turn: so what starts there is known
    own = own.withColumn("plainly", F.col("hard") | F.col("free") & F.col("looks"))
    new = F.col("hard") | F.col("free") & (F.col("looks") | F.col("turns") & F.coalesce(lag("plainly"), F.lit(False)))
    own = own.withColumn("new", new).withColumn("para", F.sum(F.col("new").cast("int")).over(w))
    bare = F.regexp_replace("text", r"^(?U)\s+", "")
    cut = F.when(F.col("new"), F.expr("substring(text, if(kind = 'p', mark, 0) + 1)")).otherwise(bare)
    own = own.withColumns({"piece": cut, "tail": last(F.col("t"), 2), "next": F.lead(bare).over(Window.partitionBy(*keys, "para").orderBy(order))})
    hyphen = F.col("tail").rlike(r"^\p{L}-$") & (trimmed(F.col("piece"), False).endswith("-")) & F.col("next").rlike(r"^\p{Ll}")
    glued = F.when(F.col("next").isNull(), F.col("piece")).when(hyphen, F.regexp_replace(trimmed(F.col("piece"), False), "-$", "")).when(F.col("piece").endswith(" "), F.col("piece")).otherwise(F.concat(trimmed(F.col("piece"), False), F.lit(" ")))
    first = lambda c: F.min_by(c, order)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), glued.alias("g")))), lambda x: x.g), "")
    made = own.groupBy(*keys, "para").agg(first(F.when((F.col("kind") == "p") & (F.col("mark") > 0), "li").otherwise(F.col("kind"))).alias("kind"), F.count("*").cast("int").alias("lines"), F.bool_and("bold").alias("bold"), text.alias("text"))
    made = made.withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    is_p = F.col("kind") == "p"
    title = is_p & (F.col("lines") == 1) & F.col("bold") & (F.char_length("text") < TITLE_MOST) & ~last(F.col("text")).isin(".", ",", ";", ":")
    # a stat line has four values: figures or dashes; few other texts are searched for pairs
    figures = F.char_length("text") - F.char_length(F.translate("text", "0123456789—–-", ""))
    is_stat = F.when(figures >= stats.LEAST_PAIRS, stats.stat_table(F.col("text")).isNotNull()).otherwise(F.lit(False))
    kind = F.when(is_p & is_stat, "table").when(title, "h4").when(F.col("kind").rlike("^h") & (F.char_length("text") > HEADING_MOST), "p").otherwise(F.col("kind"))
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("para")) - 1).alias("ord")
    return made.select(*keys, place, kind.alias("kind"), "lines", "text")


def tidied(blocks: DataFrame, doc: str, across: bool = True) -> DataFrame:
    """The stream of a document's blocks (page_no, ord, kind, text), a break before each page: doc, ord, kind, text.

    Headings at the top of a page that repeat the last one before it go; drop caps go before the next text;
    paragraphs that go on with a small letter are joined to the text before, over pages if told so.
    """
    pages, place = Window.partitionBy(doc).orderBy("page_no"), Window.partitionBy(doc).orderBy("page_no", "ord")
    key = F.when(F.col("kind").rlike("^h"), F.concat_ws("|", "kind", F.lower(F.regexp_replace(strip(F.col("text")), r"(?U)\s+", " "))))
    own = blocks.select(doc, "page_no", "ord", "kind", "text").withColumn("title", key)
    titles = own.groupBy(doc, "page_no").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("ord"))).alias("last"))
    titles = titles.select(doc, "page_no", F.last("last", True).over(pages.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    again = F.min(F.coalesce(F.col("title") == F.col("before"), F.lit(False))).over(Window.partitionBy(doc, "page_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    own = own.join(titles, [doc, "page_no"]).withColumn("again", again).where(~F.col("again"))
    holds = ~F.col("kind").isin("dropcap", "table", "image", "box")
    own = own.withColumn("g", F.count_if(holds).over(place.rowsBetween(Window.unboundedPreceding, -1)))
    caps = own.where("kind = 'dropcap'").groupBy(doc, "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "ord", strip(F.col("text")).alias("t")))), lambda x: x.t), "").alias("caps"))
    own = own.where("kind <> 'dropcap'").join(caps, [doc, "g"], "left").withColumn("text", F.when(holds, F.concat(F.coalesce("caps", F.lit("")), "text")).otherwise(F.col("text")))
    near = place if across else Window.partitionBy(doc, "page_no").orderBy("ord")
    before = F.lag("text").over(near)
    goes_on = (F.col("kind") == "p") & F.lag("kind").over(near).isin("p", "li") & ~last(trimmed(before)).rlike(ENDS) & F.col("text").rlike(r"^(?U)\s*\p{Ll}")
    own = own.withColumn("joins", F.coalesce(goes_on, F.lit(False)))
    own = own.withColumn("grp", F.sum((~F.col("joins")).cast("int")).over(place))
    at = F.struct("page_no", "ord")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "ord", "text"))), lambda x: x.text), " ")
    made = own.groupBy(doc, "grp").agg(F.min(at).alias("at"), F.min_by("kind", at).alias("kind"), text.alias("text")).select(doc, "at.page_no", "at.ord", "kind", "text")
    breaks = blocks.select(doc, "page_no").distinct().select(doc, "page_no", F.lit(-1).alias("ord"), F.lit("break").alias("kind"), F.lit("").alias("text"))
    return made.unionByName(breaks).select(doc, (F.row_number().over(place) - 1).alias("ord"), "kind", "text")
