"""Quality rules as a short-circuit cascade, cheap and decisive rules first.

A rule tells from measures of a text whether it is rejected. Each task first takes a bounded sample, its
first SAMPLE texts, evaluates every rule on all of them with a clock beside it, and then orders the rules by
rejection per cost: again and again the rule that rejects most of the sample's remaining texts for a second
of work. The task's other texts run through the rules in that order; a rejected text leaves, and what the
next rule needs is measured on the rest alone. A text is kept if no rule rejects it, so the order decides on
the work and never on the verdict, and a task that runs again says the same.

Measures are arrays over a slice of texts: words are runs without 0x20 and 0x09-0x0D, lines are cut at \\n,
words and lines are compared by 64-bit hashes. Measures asked for in ``report`` are taken for all texts, and
rules on them cost nothing more.

Edge cases: a null text has no words and is rejected for that, like an empty one; rows that repeat are judged
alike; very long texts are a slice of their own and measured whole; an empty table gives no rows. ``judge``
reads no other columns than it is told; in ``keep`` all columns pass, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import arrow_map, blank, mix, span_hashes, spans, text_slices, utf8

#: Texts on which a task tries all rules to order them.
SAMPLE = 200
WINDOW = 3
_U = np.uint64
_ODD = np.random.default_rng(12).integers(1, 1 << 63, WINDOW + 1, dtype=np.uint64) * _U(2) + _U(1)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
#: Letters: A-Z, a-z and all from U+00C0 on, by the first byte.
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 0xC3)
#: Texts are cut anew when fewer than this share of them is left.
RECUT = 0.8


class Texts:
    """Measures of some texts, each an array with a number for every text, taken when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    @cached_property
    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        return utf8(self.column)

    def _each(self, mask: np.ndarray) -> np.ndarray:
        """How many of the bytes of each text the mask marks."""
        run = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=run[1:])
        return np.diff(run[self.raw[1]])

    def _of(self, start: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.raw[1], start, "right") - 1

    def _counted(self, text: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(text if mask is None else text[mask], minlength=len(self.column)).astype(np.int64)

    @cached_property
    def blanks(self) -> np.ndarray:
        return blank(self.raw[0])

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return spans(*self.raw, ~self.blanks)

    @cached_property
    def word_text(self) -> np.ndarray:
        return self._of(self.words[0])

    @cached_property
    def n_words(self) -> np.ndarray:
        return self._counted(self.word_text)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._each(((self.raw[0] & 0xC0) != 0x80) & ~self.blanks)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._each(_SYMBOL[self.raw[0]])

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        s, e = self.words
        run = np.zeros(len(self.raw[0]) + 1, np.int64)
        np.cumsum(_LETTER[self.raw[0]], out=run[1:])
        return self._counted(self.word_text, run[e + 1] > run[s])

    @cached_property
    def n_capitals(self) -> np.ndarray:
        return self._each(_UPPER[self.raw[0]])

    @cached_property
    def n_small(self) -> np.ndarray:
        return self._each(_LOWER[self.raw[0]])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of each line that holds a word."""
        data, at = self.raw
        s, e = spans(data, at, data != 10)
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~self.blanks, out=run[1:])
        some = run[e + 1] > run[s]
        return s[some], e[some]

    @cached_property
    def line_text(self) -> np.ndarray:
        return self._of(self.lines[0])

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._counted(self.line_text)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        key = mix(span_hashes(self.raw[0], *self.lines) + self.line_text.astype(np.uint64) * _ODD[0])
        order = np.argsort(key)
        key = key[order]
        return self._counted(self.line_text[order][1:], key[1:] == key[:-1])

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        words, text = span_hashes(self.raw[0], *self.words), self.word_text
        n = max(0, len(words) - WINDOW + 1)
        key = text[:n].astype(np.uint64) * _ODD[WINDOW]
        for j in range(WINDOW):
            key += words[j : j + n] * _ODD[j]
        whole = np.flatnonzero(text[:n] == text[WINDOW - 1 : WINDOW - 1 + n])
        key = mix(key[whole])
        order = np.argsort(key)
        key, twice = key[order], np.zeros(len(order), bool)
        twice[1:] = key[1:] == key[:-1]
        twice[:-1] |= twice[1:]
        covered, at = np.zeros(len(words), bool), whole[order[twice]]
        for j in range(WINDOW):
            covered[at + j] = True
        return self._counted(text, covered)

    @cached_property
    def n_bullet_lines(self) -> np.ndarray:
        data, (s, _) = self.raw[0], self.lines
        at = np.append(np.flatnonzero(~self.blanks), 0)
        first = at[np.searchsorted(at[:-1], s)]
        big = np.append(data, np.zeros(2, np.uint8))
        return self._counted(self.line_text, np.isin(big[first], (42, 45)) | ((big[first] == 0xE2) & (big[first + 1] == 0x80) & (big[first + 2] == 0xA2)))

    @cached_property
    def n_broken_lines(self) -> np.ndarray:
        """Lines that end with three dots or the character for them."""
        data, (s, e) = self.raw[0], self.lines
        at = np.append(0, np.flatnonzero(~self.blanks))
        last = at[np.searchsorted(at[1:], e, "right")] + 2
        big = np.append(np.zeros(2, np.uint8), data)
        ends = [big[last - k] for k in (2, 1, 0)]
        return self._counted(self.line_text, (last - 4 >= s) & (ends[0] == 46) & (ends[1] == 46) & (ends[2] == 46) | (ends[0] == 0xE2) & (ends[1] == 0x80) & (ends[2] == 0xA6))


@dataclass(frozen=True)
class Rule:
    """A name, and for some texts which of them are rejected."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    Rule("few words", lambda t: t.n_words < 50),
    Rule("repeated words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word lengths", lambda t: (t.word_chars < 3 * t.n_words) | (t.word_chars > 10 * t.n_words)),
    Rule("words without letters", lambda t: 10 * t.n_letter_words < 8 * t.n_words),
    Rule("capitals", lambda t: t.n_capitals > t.n_small),
    Rule("repeated lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("bullets", lambda t: 10 * t.n_bullet_lines > 9 * t.n_lines),
    Rule("broken lines", lambda t: 10 * t.n_broken_lines > 3 * t.n_lines),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(column: pa.Array, report: Iterable[str]) -> Texts:
    texts = Texts(column)
    for name in report:
        getattr(texts, name)
    return texts


def tried(texts: Texts, rules: Sequence[Rule], report: Iterable[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """What each rule rejects of the texts (texts, rules), and the CPU seconds it took by itself beside the reported measures."""
    out, cost = np.zeros((len(texts.column), len(rules)), bool), np.zeros(len(rules))
    known = {k: texts.__dict__[k] for k in report if k in texts.__dict__}
    for i, rule in enumerate(rules):
        alone = Texts(texts.column)
        alone.__dict__.update(known)
        began = time.process_time()
        out[:, i] = rule.rejects(alone)
        cost[i] = time.process_time() - began
    return out, cost


def ordered(rejects: np.ndarray, cost: np.ndarray) -> list[int]:
    """Places of the rules: always the one next that rejects most of what is left for its cost; ties as declared."""
    left, todo, order = np.ones(len(rejects), bool), list(range(len(cost))), []
    while todo:
        gain = {i: (int(rejects[left, i].sum()) + 0.5 / (len(rejects) + 1)) / (cost[i] + 1e-7) for i in todo}
        best = max(todo, key=lambda i: (gain[i], -i))
        order.append(best)
        todo.remove(best)
        left &= ~rejects[:, best]
    return order


def cascade(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """The texts that no rule rejects; each rule sees those that the rules before it left."""
    left, own = np.arange(len(texts.column)), np.arange(len(texts.column))
    for rule in rules:
        if not len(left):
            break
        if len(left) < RECUT * len(own):
            own, texts = left, Texts(texts.column.take(pa.array(np.searchsorted(own, left))))
        bad = rule.rejects(texts)
        left = left[~bad[np.searchsorted(own, left)]]
    return left


class Cascade:
    """The rules of one task: unordered until SAMPLE texts were tried."""

    def __init__(self, rules: Sequence[Rule], report: Iterable[str] = ()):
        self.rules, self.report = list(rules), tuple(report)
        self.seen, self.rejects, self.cost = 0, [], np.zeros(len(self.rules))

    def __call__(self, texts: Texts) -> np.ndarray:
        """Whether each text is kept."""
        kept = np.zeros(len(texts.column), bool)
        if self.seen < SAMPLE:
            rejects, cost = tried(texts, self.rules, self.report)
            kept[:] = ~rejects.any(1)
            self.seen, self.cost = self.seen + len(kept), self.cost + cost
            self.rejects.append(rejects)
            if self.seen >= SAMPLE:
                self.rules = [self.rules[i] for i in ordered(np.concatenate(self.rejects), self.cost)]
        else:
            kept[cascade(texts, self.rules)] = True
        return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, report: Sequence[str] = MEASURES, reasons: bool = False) -> DataFrame:
    """id, the reported measures, kept; with reasons all rules are tried on all texts, and those that reject are named."""

    def run(batches):
        judged = Cascade(rules, report)
        names = np.array([r.name for r in rules], object)
        for b in text_slices(batches):
            texts = measured(b.column(1), report)
            columns = [b.column(0), *(pa.array(getattr(texts, m)) for m in report)]
            if reasons:
                rejects = tried(texts, rules, report)[0]
                columns += [pa.array(~rejects.any(1)), pa.array([names[x].tolist() for x in rejects], pa.list_(pa.string()))]
            else:
                columns.append(pa.array(judged(texts)))
            yield pa.record_batch(columns, names=["id", *report, "kept", *["reasons"] * reasons])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"id {own.schema['id'].dataType.simpleString()}", *(f"{m} long" for m in report), "kept boolean", *["reasons array<string>"] * reasons])
    return arrow_map(own, run, schema).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows, with all their columns, whose texts no rule rejects."""
    place = docs.columns.index(text_col)

    def run(batches):
        judged = Cascade(rules)
        for b in text_slices(batches, text_col):
            yield b.filter(pa.array(judged(Texts(b.column(place)))))

    return arrow_map(docs, run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    told = judge(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return told.select("doc_id", *MEASURES, failed.alias("base_failed"), "kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
s AS (SELECT *, [[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, greatest(len(w) - 1, 1))] AS s, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM s)),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM x WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{C0}-\x{10FFFF}]'))) AS n_letter, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[a-z]')) AS n_lower,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_broken
  FROM s LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_letter < 8 * n_words OR n_upper > n_lower
  OR 2 * n_dup_lines > n_lines OR 10 * n_bullet > 9 * n_lines OR 10 * n_broken > 3 * n_lines) AS kept FROM m
"""
