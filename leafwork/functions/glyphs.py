"""Ornaments: decorative characters and symbol fonts taken out of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of decorative characters, single ones, and names of symbol fonts.
DECOR = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{25A0}-\x{25FF}\x{1F300}-\x{1FAFF}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FFFD}⁂※❧☙⸙⁕⁜]"
SYMBOL_FONT = "(?i)dingbat|wingding|webding|zapf|^symbol|[-+]symbol|ornament|fleur|glyph|icon|awesome|marlett|bullets|decor|border|frame"


def without_glyphs(spans: Column) -> Column:
    """The spans of a line (text, font first) without ornaments; null if no text is left.

    A single glyph that leads a line of several spans becomes a bullet, as does one before a blank.
    """
    n = F.size(spans)

    def change(s: Column, i: Column) -> Column:
        symbol = s.font.rlike(SYMBOL_FONT)
        lead, kept = F.regexp_replace(s.text, r"(?U)^\s+", ""), F.regexp_replace(s.text, DECOR, "")
        rest = F.when(symbol, "").otherwise(kept)
        alone = (i == 0) & (n > 1) & (F.char_length(F.regexp_replace(lead, r"(?U)\s+$", "")) == 1)
        before = (i == 0) & ~symbol & (F.char_length(lead) > 2) & F.substring(lead, 1, 1).rlike(DECOR) & (F.substring(lead, 2, 1) == " ") & kept.rlike(r"(?U)\S")
        new = F.when(alone, "• ").when(before, F.concat(F.lit("• "), F.regexp_replace(rest, r"(?U)^\s+", ""))).otherwise(rest)
        return F.when(symbol | s.text.rlike(DECOR), s.withField("text", F.when(new.rlike(r"(?U)\S"), new))).otherwise(s)

    kept = F.filter(F.transform(spans, change), lambda s: s.text.isNotNull())
    text = F.regexp_replace(F.array_join(F.transform(kept, lambda s: s.text), ""), r"(?U)\s", "")
    ornament = text.rlike("^[*~•·°=_]+$") & ((F.char_length(text) >= 2) | (text == "•"))
    return F.when((text != "") & ~ornament, kept)
