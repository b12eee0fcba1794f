"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

A profile lists the most frequent n-grams of one to three letters, blanks standing for runs of
other characters. A document's own profile is compared with each language's: every n-gram adds
the distance of its two ranks, or the profile length where the language lacks it. The nearest
language wins; ties go to the first in alphabetical order.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing was learned. Texts are read whole. Rows of the same text get the same answer; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import arrow_map, codepoints, text_slices

PROFILE = 400
#: More labels than this can't be profiles held by every task.
MOST_LANGUAGES = 2000
#: Counted n-grams that a task holds before it adds them up and passes them on.
COUNTED_MOST = 1_000_000
_SYMBOLS = 255
_table: np.ndarray | None = None


def symbols() -> np.ndarray:
    """For each code point 0 if it is no letter, else a symbol of its lower-case letter (1 to 255)."""
    global _table
    if _table is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (_SYMBOLS - 26)
        _table = out
    return _table


def grams(texts: pa.Array):
    """For each text the codes of its n-grams, or None for a text without letters."""
    cps, at, _ = codepoints(texts)
    sym = symbols()[cps]
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0  # of other characters only the first of a run stays, as a blank
    starts = at[:-1][at[:-1] < len(sym)]
    keep[starts] = sym[starts] > 0
    where = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=where[1:])
    short, begin = sym[keep], where[at]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        own = short[a:b]
        if not len(own) or not own.any():
            yield None
            continue
        x = np.zeros(len(own) + 2, np.uint32)
        x[1 : len(own) + 1] = own
        x = x[: len(own) + 1 + (x[len(own)] > 0)]
        two = (x[:-1] << 8) | x[1:]
        three = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        yield np.concatenate([own[own > 0] | 1 << 24, two[two > 0] | 2 << 24, three | 3 << 24])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edge = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[edge], np.diff(np.append(edge, len(codes)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """For each language its most frequent n-grams in order, over all rows with a text and a language.

    What reaches the driver is bounded: size rows for each of at most MOST_LANGUAGES languages.
    """

    def run(batches):
        held: dict[str, list] = {}
        n = 0

        def flush():
            for lang, parts in held.items():
                codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["lang", "code", "n"])

        for b in text_slices(batches):
            langs, parts = b.column(1).to_pylist(), {}
            for lang, codes in zip(langs, grams(b.column(0)), strict=True):
                if codes is not None:
                    parts.setdefault(lang, []).append(codes)
            for lang, codes in parts.items():
                held.setdefault(lang, []).append(counted(np.concatenate(codes)))
                n += len(held[lang][-1][0])
            if n > COUNTED_MOST:
                yield from flush()
                held, n = {}, 0
        yield from flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = arrow_map(rows, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for lang, code, _ in sorted(ranked.select("lang", "code", "rank").limit(size * MOST_LANGUAGES + 1).collect(), key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(code)
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    return {lang: np.array(codes, np.uint32) for lang, codes in out.items()}


class Ranker:
    """Out-of-place distances to a set of language profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.zeros(0, np.uint32)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, codes: np.ndarray | None) -> tuple[str, float]:
        """The nearest language and, as score, 1 less the share of the largest possible distance."""
        if codes is None or not self.langs:
            return "und", 0.0
        own, n = counted(codes)
        key = ((np.int64(1) << 38) - n.astype(np.int64)) << 25 | np.arange(len(own))
        if len(own) > self.size:
            order = np.argpartition(key, self.size)[: self.size]
            order = order[np.argsort(key[order])]
        else:
            order = np.argsort(key)
        top = own[order]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at[self.codes[at] != top] = len(self.codes)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top), dtype=np.int32))).sum(1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(top)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """All columns of the documents, and lang_pred and score (which replace columns of these names)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    where = kept.index(text_col)

    def run(batches):
        ranker = Ranker(profiles, size)
        for b in text_slices(batches, text_col):
            texts = b.column(where)
            said = [ranker.predict(g) for g in grams(texts)]
            yield pa.record_batch([*b.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = T.StructType([*docs.select(kept).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs.select(kept), run, schema)


def held_out():
    """The column that tells the documents kept for testing: a quarter by a checksum of doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
