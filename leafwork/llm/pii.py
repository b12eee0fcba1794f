"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Kinds: email, ip, card (Luhn), phone by the base patterns, and iban (mod 97), national numbers
(``taxid``) and secrets (keys of known forms, and values given to names such as ``token``, if their
characters are mixed enough) added by the method. Positions are code points, end exclusive.

Edge cases: a null or empty text has no spans; every text is read whole; every pattern is
linear in the text's length, as a match starts only where a run of its characters starts.
Repeated rows give repeated results; other input columns are dropped, so clashing names do
no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import arrow_map, text_slices

KINDS = ("email", "ip", "card", "phone")

# The mailbox part is taken leftwards from each @, so that long runs without one cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_TAXID = re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])")

# Forms of keys, and names that secrets are given to.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_GIVEN = re.compile(r"(?i)(?<![a-z0-9])(?:[a-z0-9]+[_-])?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?key)[\"']?[\x20\t]*(?:=|:|=>)[\x20\t]*(?P<open>[\"'`]?)(?P<value>[^\s\"'`,;]{8,})")
# What such keys and names hold: texts without any aren't searched.
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ")
_GIVEN_WORDS = ("passw", "pwd", "secret", "token", "key")

# Base score by kind, and words that make a span of the kind likelier.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "taxid": 0.4, "secret": 0.5}
CONTEXT = {
    "email": ("mail", "contact", "write", "address", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "portable"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "taxid": ("ssn", "social", "security", "tax"),
    "secret": ("secret", "token", "key", "password", "credential", "credentials", "login"),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
#: Spans of kinds outside the base that score less are dropped.
LEAST_SCORE = 0.5

_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += _DOUBLED[d] if i % 2 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number without blanks has the right check digits."""
    if not 15 <= len(iban) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _MAILBOX:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.span()


def _taxids(text: str) -> Iterator[tuple[int, int]]:
    for m in _TAXID.finditer(text):
        yield m.span()


def mixed(value: str) -> bool:
    """Whether a value looks drawn rather than written: characters of two kinds, at least three bits each."""
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return kinds >= 2 and bits >= min(3.0, 0.85 * math.log2(n))


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span() for m in _KEY.finditer(text)] if any(x in text for x in _KEY_STARTS) else []
    if "-----BEGIN" in text:
        found += [m.span() for m in _PEM.finditer(text)]
    if any(x in text.lower() for x in _GIVEN_WORDS):
        found += [m.span("value") for m in _GIVEN.finditer(text) if mixed(m["value"])]
    done = 0
    for s, e in sorted(found):
        if s >= done:
            yield s, e
            done = e


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "taxid": _taxids, "secret": _secrets}


def score(text: str, kind: str, start: int, end: int) -> float:
    """Base score of the kind, raised if one of its context words stands nearby."""
    near = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
    hit = any(re.search(rf"\b{w}\b", near) for w in CONTEXT[kind])
    return min(1.0, BASE_SCORE[kind] + CONTEXT_GAIN * hit)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All (kind, start, end, score) of a text, by kind as in FINDERS, then start."""
    if not text:
        return []
    found = []
    for kind, finder in FINDERS.items():
        for s, e in finder(text):
            rated = score(text, kind, s, e)
            if kind in KINDS or rated >= LEAST_SCORE:
                found.append((kind, s, e, rated))
    return found


def mask(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each found span replaced by its kind in brackets; spans that overlap are replaced as one."""
    if not found:
        return text
    out, done = [], 0
    for kind, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its spans (kind, start, end, score)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in text_slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], names=["id", "spans"])

    out = arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, spans array<struct<kind string, start int, end int, score double>>")
    return out.withColumnRenamed("id", id_col)


def mask_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with all their columns, personal data in the text masked; rows without any keep their text."""
    where, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in text_slices(batches, text_col):
            texts = [mask(t, find(t)) for t in b.column(where).to_pylist()]
            columns = [pa.array(texts, b.schema.field(where).type) if i == where else b.column(i) for i in range(len(names))]
            yield pa.record_batch(columns, names=names)

    return arrow_map(docs, run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds by document, the digest of the base spans, all spans, their number and the highest score."""
    kinds = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in text_slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                found = find(t)
                base = [x for x in found if x[0] in KINDS]
                rows.append([*(sum(x[0] == k for x in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found), max((x[3] for x in found), default=0.0)])
            columns = zip(*rows, strict=True)
            yield pa.record_batch([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:], strict=True))], schema=kinds)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, score double")
