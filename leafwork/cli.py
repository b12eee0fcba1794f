"""Command line: converts a folder of layout tables into journals."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafwork.functions.pages import parse_pages
from leafwork.plans.convert import Layout, Options, convert, write
from leafwork.sources.layout import SCHEMAS, read
from leafwork.sources.worlds import SettingsError, default_data_dir, list_worlds, output_and_prefix


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafwork", description=__doc__)
    p.add_argument("layout", nargs="?", help="folder with the layout tables as Parquet")
    p.add_argument("-o", "--out", help="output folder")
    p.add_argument("-p", "--pages", help="pages, such as 1-3,7,10-")
    p.add_argument("-n", "--name", help="name of the journal")
    p.add_argument("--split", choices=("page", "heading", "none"), default="page")
    p.add_argument("--split-level", type=int, choices=(1, 2, 3), default=2)
    p.add_argument("--image-format", choices=("webp", "png", "jpg"), default="webp")
    p.add_argument("--dpi", type=int, default=150)
    p.add_argument("--min-image", type=float, default=48.0)
    p.add_argument("--asset-prefix")
    p.add_argument("--world")
    p.add_argument("--data-dir")
    for name in ("images", "tables", "boxes", "rolls", "links"):
        p.add_argument(f"--no-{name}", dest=name, action="store_false")
    for name in ("macro", "preview"):
        p.add_argument(f"--no-{name}", dest=name, action="store_false", help=f"write no {name}")
    p.add_argument("--list-worlds", action="store_true", help="name the worlds of the data folder, and end")
    p.add_argument("--keep-headers", dest="strip_headers", action="store_false")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list_worlds:
        print(*list_worlds(args.data_dir or default_data_dir() or ""), sep="\n")
        return 0
    if not args.layout:
        parser().error("a folder of layout tables is needed")
    spark = SparkSession.builder.appName("leafwork").getOrCreate()
    try:
        layout = Layout(**{name: read(spark, args.layout, name) for name in SCHEMAS})
        if args.pages:
            numbers = layout.docs.select("doc_id", F.posexplode(parse_pages(F.lit(args.pages), F.col("n_pages"))).alias("sel_ord", "page_no"))
            layout = layout.select(numbers)
        out, prefix = output_and_prefix("", args.out, args.world, args.data_dir)
        options = Options(
            args.images, args.tables, args.boxes, args.strip_headers, args.rolls, args.links, args.dpi, args.image_format, args.min_image, args.split, args.split_level,
            args.asset_prefix or (prefix.rstrip("/") if args.world else None),
        )
        write(convert(layout, options, args.name), out, ("entry", *(k for k in ("macro", "preview") if getattr(args, k))))
    except (SettingsError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
