"""Stat lines: abbreviations with values, as in ``FOR 50 CON 60 ...``, made into tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of characteristics, and the form of their values.
ABBREVIATIONS = (
    "FOR", "CON", "TAM", "DES", "INT", "POD", "APA", "EDU", "SAN", "PV", "PM", "MOV", "SOR", "Sorte", "BD", "Corpo",
    "STR", "SIZ", "DEX", "POW", "APP", "HP", "MP", "Luck", "DB", "Build", "WIS", "CHA",
)
ABBR = "|".join(sorted(ABBREVIATIONS, key=len, reverse=True))
VALUE = r"(?:[—–-]|[+−–-]?[0-9]+(?:[.,][0-9]+)?%?(?:\s*\([+−–-]?[0-9]+\))?)"
PAIR = rf"(?U)(?<![\w])({ABBR})\s*:?\s*({VALUE})(?![\w])"
LEAST_PAIRS, COVERED, ONE_ROW = 4, 0.8, 6


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs(text: Column) -> Column:
    """Array of structs a (abbreviation) and v (value) found in a text."""
    names, values = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2))
    return F.zip_with(names, values, lambda a, v: F.struct(a.alias("a"), v.alias("v")))


def coverage(text: Column) -> Column:
    """Share of a text's characters, blanks apart, that pairs take up."""
    solid = lambda c: F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    return solid(F.array_join(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), "")) / solid(text)


def pair_rows(found: Column) -> Column:
    """Rows of a table: a row of abbreviations above one of values, two of each beyond six pairs, padded."""
    n = F.size(found)
    width = F.when(n <= ONE_ROW, n).otherwise(F.ceil(n / 2).cast("int"))

    def both(part: Column, width: Column) -> Column:
        pad = F.array_repeat(F.lit(""), width - F.size(part))
        return F.array(F.concat(F.transform(part, lambda p: p.a), pad), F.concat(F.transform(part, lambda p: p.v), pad))

    def rows(width: Column) -> Column:
        step = F.greatest(width, F.lit(1))
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, step)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda i: named(F.slice(found, i + 1, step), lambda part: both(part, width))))

    return named(width, rows)


def stat_table(text: Column) -> Column:
    """Rows of the table that a stat line is, or null.

    Either four pairs or more cover four fifths of the line, or as many abbreviations (four at
    least) are followed by as many values.
    """

    def listed(words: Column) -> Column:
        half = (F.size(words) / 2).cast("int")
        names, values = F.slice(words, F.lit(1), half), F.slice(words, half + 1, half)
        fits = (F.size(words) % 2 == 0) & (half >= LEAST_PAIRS) & F.forall(names, lambda x: x.rlike(f"^(?:{ABBR})$")) & F.forall(values, lambda x: x.rlike(f"(?U)^{VALUE}$"))
        return F.when(fits, F.array(names, values))

    def read(own: Column) -> Column:
        words = F.regexp_extract_all(own, F.lit(rf"(?U){VALUE}|\S+"), F.lit(0))
        return named(pairs(own), lambda found: F.when((F.size(found) >= LEAST_PAIRS) & (coverage(own) >= COVERED), pair_rows(found)).otherwise(named(words, listed)))

    return named(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""), read)


def stat_grid(rows: Column) -> Column:
    """Rows of alternating abbreviations and values made into header and value rows, or null."""
    full = F.transform(rows, lambda r: F.filter(r, lambda c: c != ""))
    even = lambda r: F.filter(r, lambda c, i: i % 2 == 0)
    odd = lambda r: F.filter(r, lambda c, i: i % 2 == 1)
    fits = F.forall(full, lambda r: (F.size(r) >= 4) & (F.size(r) % 2 == 0) & F.forall(even(r), lambda c: c.rlike(f"^(?:{ABBR})$")) & F.forall(odd(r), lambda c: c.rlike(f"(?U)^{VALUE}$")))
    width = (F.array_max(F.transform(full, F.size)) / 2).cast("int")
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    return F.when((F.size(rows) > 0) & fits, F.flatten(F.transform(full, lambda r: F.array(pad(even(r)), pad(odd(r))))))


def has_header(rows: Column, first_bold: Column, rest_bold: Column) -> Column:
    """Whether a gridless table's first row is its header: bold above others, or no number above numbers."""
    below = F.exists(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")).rlike("^[0-9+−–-]"))
    numeric = F.get(F.get(rows, F.lit(0)), F.lit(0)).rlike("^[+−–-]?[0-9]+([-–][0-9]+)?$")
    return (first_bold & ~rest_bold) | (below & ~numeric)


def drop_empty_columns(rows: Column) -> Column:
    """Rows without the columns that are empty throughout; null if fewer than two are left."""
    n = F.array_max(F.transform(rows, F.size))
    kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.exists(rows, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    return F.when(F.size(kept) >= 2, F.transform(rows, lambda r: F.transform(kept, lambda i: F.get(r, i))))


def ruled_table(rows: Column) -> Column:
    """Whether a found grid is a table: two rows and columns, three cells and 40 % filled, no cell over 250."""
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: c != "")
    wide = F.array_max(F.transform(rows, F.size))
    return (F.size(rows) >= 2) & (wide >= 2) & (F.size(filled) >= 3) & (F.size(filled) >= 0.4 * F.size(cells)) & (F.array_max(F.transform(filled, F.char_length)) <= 250)


def is_row_candidate(cells: Column) -> Column:
    """Whether a text row may belong to a table: 2 to 14 cells, none over 160 characters, one of 30 at most."""
    lengths = F.transform(cells, F.char_length)
    return F.size(cells).between(2, 14) & (F.array_max(lengths) <= 160) & (F.array_min(lengths) <= 30)
