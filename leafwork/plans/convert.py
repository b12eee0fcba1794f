"""Conversion of layout tables into journals."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.geometry import Rect, in_margin
from leafwork.functions.glyphs import without_glyphs
from leafwork.functions.text import slugify, strip
from leafwork.operators import furniture, sizes
from leafwork.operators import journal as J
from leafwork.operators.blocks import page_blocks

# Titles that say nothing.
GENERIC_TITLES = ("untitled", "sem título", "document", "documento")


def display_name(given: Column, title: Column, stem: Column) -> Column:
    """The given name, else a title that says something, else the file's stem."""
    own = F.nullif(strip(F.coalesce(title, F.lit(""))), F.lit(""))
    return F.coalesce(F.nullif(given, F.lit("")), F.when(F.lower(own).isin(*GENERIC_TITLES), None).otherwise(own), stem)


@dataclass(frozen=True)
class Options:
    """Switches and numbers of a conversion."""

    images: bool = True
    tables: bool = True
    boxes: bool = True
    strip_headers: bool = True
    rolls: bool = True
    links: bool = True
    dpi: int = 150
    image_format: str = "webp"
    min_image_pt: float = 48.0
    split: str = "page"
    split_level: int = 2
    asset_prefix: str | None = None
    now_ms: int = 0

    def __post_init__(self):
        if self.split not in ("page", "heading", "none"):
            raise ValueError(f"split must be page, heading or none, not {self.split!r}")
        if self.image_format not in ("webp", "png", "jpg"):
            raise ValueError(f"unknown image format {self.image_format!r}")


@dataclass
class Layout:
    """The layout tables of documents (see leafwork.sources.layout.SCHEMAS)."""

    docs: DataFrame
    pages: DataFrame
    spans: DataFrame
    grid_tables: DataFrame
    image_infos: DataFrame
    drawings: DataFrame

    def select(self, selected: DataFrame) -> Layout:
        """Only the pages in ``selected`` (doc_id, page_no, sel_ord); the filter reaches every scan."""
        keys = ["doc_id", "page_no"]
        own = self.pages.drop("sel_ord").join(selected, keys)
        some = lambda df: df.join(selected, keys, "left_semi")
        return Layout(self.docs, own, some(self.spans), some(self.grid_tables), some(self.image_infos), some(self.drawings))


_PAGE = ["doc_id", "page_no"]
_LINE = [*_PAGE, "block_no", "line_no"]


def lines_of(layout: Layout) -> DataFrame:
    """Horizontal lines with their spans in order, text, place on the page, and the page's sel_ord."""
    span = F.struct("span_no", "text", "font", "size", "flags", "x0", "y0", "x1", "y1")
    rows = layout.spans.where((F.coalesce("dir_x", F.lit(1.0)) > 0.99) & (F.abs(F.coalesce("dir_y", F.lit(0.0))) < 0.05))
    lines = rows.groupBy(*_LINE).agg(F.sort_array(F.collect_list(span)).alias("spans"), *(F.min("l" + c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    page = layout.pages.select(*_PAGE, "sel_ord", *(F.col(c).alias("p" + c) for c in ("x0", "y0", "x1", "y1")))
    return placed(lines.join(page, _PAGE))


def placed(lines: DataFrame) -> DataFrame:
    """Adds text, y_frac and in_margin."""
    y = ((F.col("y0") + F.col("y1")) / 2 - F.col("py0")) / (F.col("py1") - F.col("py0"))
    text = F.array_join(F.transform("spans", lambda s: s.text), "")
    return lines.withColumns({"text": text, "y_frac": y, "in_margin": in_margin(Rect(), Rect("p"))})


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines without ornaments; a line that changed is bounded by the spans that are left."""
    own = lines.withColumn("clean", without_glyphs(F.col("spans"))).where("clean is not null")
    same = F.col("clean") == F.col("spans")
    edge = lambda f, c: F.when(same, F.col(c)).otherwise(f(F.transform("clean", lambda s: s[c])))
    sides = {"x0": edge(F.array_min, "x0"), "y0": edge(F.array_min, "y0"), "x1": edge(F.array_max, "x1"), "y1": edge(F.array_max, "y1")}
    return placed(own.withColumns(sides).withColumn("spans", F.col("clean")).drop("clean"))


def analyze(layout: Layout, options: Options) -> dict[str, DataFrame]:
    """What is known of whole documents: furniture, printed page numbers, body sizes, heading levels, repeated images."""
    lines = lines_of(layout)
    numbered = lines.withColumn("ord", F.struct("block_no", "line_no"))
    found = furniture.find_furniture(numbered.drop("line_no").withColumnRenamed("ord", "line_no"), "doc_id")
    if not options.strip_headers:
        found = found.limit(0)
    marked = furniture.mark_furniture(lines, found, "doc_id").where("NOT is_furniture")
    spans = marked.select("doc_id", "page_no", "sel_ord", "block_no", "line_no", F.explode("spans").alias("s")).select("doc_id", "page_no", "sel_ord", "block_no", "line_no", "s.*")
    spans = spans.withColumn("bold", F.col("flags").bitwiseAND(16) > 0)
    sized = sizes.dominant_sizes(spans, ["doc_id", "sel_ord", "block_no", "line_no"])
    counts = sizes.size_chars(sized.select("doc_id", "size", "chars", F.col("sel_ord").alias("page_no"), F.struct("block_no", "line_no").alias("line_no")), "doc_id")
    body = sizes.body_sizes(counts, "doc_id")
    n_pages = layout.pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return {
        "lines": lines, "furniture": found, "printed": furniture.printed_pages(lines, "doc_id", "sel_ord"), "body": body,
        "levels": sizes.heading_levels(counts, body, "doc_id"), "repeated": furniture.repeated_images(layout.image_infos, "doc_id", n_pages),
    }


def page_rows(layout: Layout, known: dict[str, DataFrame], options: Options) -> DataFrame:
    """One row for each page with all that its blocks are made of."""
    kept = cleaned(known["lines"])
    marked = furniture.mark_furniture(kept, known["furniture"], "doc_id")
    if options.strip_headers:
        marked = marked.where("NOT is_furniture")
    line = F.struct("block_no", "line_no", "x0", "y0", "x1", "y1", F.transform("spans", lambda s: F.struct(s.text.alias("text"), s.font.alias("font"), s["size"].alias("size"), s.flags.alias("flags"), s.x0.alias("x0"), s.y0.alias("y0"), s.x1.alias("x1"), s.y1.alias("y1"))).alias("spans"))
    lines = marked.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    grids = layout.grid_tables.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(F.struct("table_no", "x0", "y0", "x1", "y1", "rows"))).alias("grids"))
    images = layout.image_infos.join(known["repeated"].select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    images = images.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(F.struct("image_no", "x0", "y0", "x1", "y1"))).alias("images"))
    drawings = layout.drawings.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(F.struct("drawing_no", "x0", "y0", "x1", "y1", "fill", "color", F.col("item_ops").alias("ops")))).alias("drawings"))
    levels = known["levels"].groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("size", "level"))).alias("levels"))
    out = layout.pages
    for part in (lines, grids, images, drawings):
        out = out.join(part, _PAGE, "left")
    return out.join(known["body"], "doc_id", "left").join(levels, "doc_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(sizes.BODY_DEFAULT)))


def blocks_of(rows: DataFrame, options: Options) -> DataFrame:
    """By page its blocks as JSON: doc_id, page_no, sel_ord, blocks."""
    chosen = asdict(options)
    sides = lambda r: (r["x0"], r["y0"], r["x1"], r["y1"])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                by_block: dict[int, list] = {}
                for ln in row["lines"] or ():
                    by_block.setdefault(ln["block_no"], []).append({"spans": ln["spans"], "bbox": sides(ln)})
                page = {
                    "blocks": [by_block[k] for k in sorted(by_block)], "rect": sides(row), "page_no": row["page_no"], "stem": row["stem"],
                    "grids": [{"bbox": sides(g), "rows": g["rows"]} for g in row["grids"] or ()], "images": [sides(i) for i in row["images"] or ()],
                    "drawings": [{"bbox": sides(d), "fill": d["fill"], "color": d["color"], "ops": d["ops"] or []} for d in row["drawings"] or ()],
                }
                blocks = page_blocks(page, row["body_size"], dict(row["levels"] or ()), chosen)
                out.append(json.dumps(blocks, ensure_ascii=False))
            yield pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "page_no", "sel_ord")] + [pa.array(out, pa.string())], names=["doc_id", "page_no", "sel_ord", "blocks"])

    return rows.mapInArrow(run, "doc_id string, page_no int, sel_ord int, blocks string")


def convert(layout: Layout, options: Options = Options(), name: str | None = None) -> DataFrame:
    """One row per document: doc_id, slug, name, n_pages, n_images, entry, macro and preview (JSON, script, HTML).

    A document is the unit of output, so its blocks meet in one grouped call; documents are spread
    over the cluster by id.
    """
    known = analyze(layout, options)
    stems = layout.docs.select("doc_id", slugify(F.coalesce(F.lit(name), F.col("doc_id"))).alias("stem"), display_name(F.lit(name), F.col("title"), F.col("doc_id")).alias("name"))
    rows = page_rows(layout, known, options).join(stems.select("doc_id", "stem"), "doc_id")
    blocks = blocks_of(rows, options)
    printed = known["printed"].groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("printed").cast("string"), "pdf_page")))).alias("printed"))
    told = blocks.join(stems, "doc_id").join(printed, "doc_id", "left")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sel_ord")
        stem, shown = rows["stem"].iloc[0], rows["name"].iloc[0]
        numbers = {int(k): v for k, v in json.loads(rows["printed"].iloc[0] or "{}").items()}
        stream = [b for no, own in zip(rows["page_no"], rows["blocks"], strict=True) for b in [{"k": "break", "n": int(no) + 1}, *json.loads(own)]]
        pages = J.split(stream, options.split, options.split_level, shown)
        for i, p in enumerate(pages):
            p["id"] = J.page_id(key[0], i)
        annotate = J.annotator(pages, numbers, options.rolls, options.links)
        prefix = options.asset_prefix if options.asset_prefix is not None else f"leafwork/{stem}"
        html = lambda p, folder: J.render(p["blocks"], lambda f: f"{folder}/{f}", annotate, options.rolls)
        for p in pages:
            p["html"] = html(p, prefix)
        made = J.entry(key[0], shown, pages, f"{key[0]}.pdf", options.now_ms)
        seen = J.preview(shown, [(p["title"], html(p, stem)) for p in pages])
        n_images = sum(p["html"].count("<img ") for p in pages)
        return pd.DataFrame([[key[0], stem, shown, len(pages), n_images, json.dumps(made, ensure_ascii=False, indent=2), J.macro(made), seen]])

    return told.groupBy("doc_id").applyInPandas(run, "doc_id string, slug string, name string, n_pages int, n_images int, entry string, macro string, preview string")


def write(journals: DataFrame, path: str, kinds: tuple[str, ...] = ("entry", "macro", "preview")) -> None:
    """Journals as text, a folder for each kind and one for each slug below it."""
    for kind in kinds:
        journals.select("slug", F.col(kind).alias("value")).write.mode("overwrite").partitionBy("slug").text(f"{path}/{kind}")
