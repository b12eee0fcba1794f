"""Text expressions: keys, cleaning, numerals, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)\s+"
#: All characters that are white space in Unicode.
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trims all Unicode white space; only the ends are read, not the whole text as a pattern would."""
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, _WS, " "))


def furniture_key(c: Column) -> Column:
    """Key of running heads and feet: lower case, single blanks, runs of digits as #."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), _WS, " "), "[0-9]+", "#")


def exact_key(c: Column) -> Column:
    """Lower case with single blanks (full case folding, ss for sharp s, has no Spark equal)."""
    return F.regexp_replace(F.lower(strip(c)), _WS, " ")


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(r"^(?i)[\s\-–—]*([0-9]{1,4}|[ivxlcdm]{1,6})[\s\-–—]*$")


def half_points(c: Column) -> Column:
    """Rounds to halves, ties to even."""
    return F.rint(c * 2) / 2


# Accented Latin letters and their plain forms.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def slugify(c: Column, default: str = "journal") -> Column:
    """Lower-case ASCII letters and digits, all else hyphens; accents are dropped."""
    plain = F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit(default))


def heading_anchor(c: Column) -> Column:
    """Anchor of a heading: lower case, hyphens for white space, no quotes, 64 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), _WS, "-"), "[\"']", ""), 1, 64)


def clean_cell(c: Column) -> Column:
    """Text of a ruled table's cell: no soft hyphens, broken words joined, single blanks."""
    return collapse(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("­"), F.lit("")), r"(?U)(\w)-\n(\w)", "$1$2"))


def escape_html(c: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sentence_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "").rlike(r"[.!?:…\"”»)]$")


# Numerals spelled in two languages, and those of Rome.
SPELLED = {
    "um": 1, "dois": 2, "três": 3, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def roman(c: Column) -> Column:
    """Value of a numeral of I, V, X, L, C: a letter before a larger one counts less; null for others."""
    digits = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    values = F.transform(digits, lambda x: _lookup(ROMAN, x))
    signed = F.transform(values, lambda v, i: F.when(F.coalesce(F.get(values, i + 1), F.lit(0)) > v, -v).otherwise(v))
    return F.when(F.upper(c).rlike("^[IVXLC]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def chapter_number(c: Column) -> Column:
    """Number of a chapter, written in digits, Roman or spelled."""
    s = strip(c)
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("int")).when(s.rlike("^[IVXLCivxlc]+$"), roman(s)).otherwise(_lookup(SPELLED, F.lower(s)))
