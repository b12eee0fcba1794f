"""Byte-level BPE over rank files, encoding and decoding, without regular expressions.

Pre-tokenisation works on arrays of code-point classes (letter, number, blank, other). Each
character acts on the state of a scanner as a transition function. Composition is associative,
and as every function forgets all but the two characters before, the prefix scan ends after the
compositions with shifts 1 and 2: a text's token starts are found by comparing the class array
with shifted copies of itself, whatever the text's length. The slices between starts go through a cache of merged pieces; misses are
merged together as arrays, one best pair of every piece per step (very long pieces by a heap).
Offsets of tokens in the pool of encoded ids and in the decoded bytes are kept.

Edge cases: a null text is empty and has no tokens; one long run of a class is one piece,
merged in n log n; texts are whole; repeated rows repeat; an empty table gives an empty result.
Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import arrow_map, codepoints, text_slices

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Bytes of merged pieces that a task keeps, as estimated; a full cache starts anew, and none outlives its task.
CACHE = 32_000_000
#: What a piece takes besides its text.
_PIECE = 200
#: Longer pieces are merged by a heap.
LONG = 96

_classes: np.ndarray | None = None
_coders: dict[str, Coder] = {}


def classes() -> np.ndarray:
    """The class of each code point."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for pattern, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
            for m in regex.finditer(f"{pattern}+", every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                out[a : b + 1] = k
        out[0x1C:0x20] = OTHER  # blanks for Python alone
        out[0xD800:0xE000] = OTHER
        _classes = out
    return _classes


def starts(cps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where tokens start in the joined texts that begin at ``at``."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[cps]
    first = np.zeros(n + 1, bool)
    first[at] = True
    edge = first.copy()  # starts of runs of a class
    edge[1:n] |= c[1:] != c[:-1]
    edge[n] = True
    blank = c == BLANK
    space = cps == 32
    out = edge.copy()
    # A run's last blank stands alone, or, if it is a space, opens the next token.
    tail = np.flatnonzero(blank & edge[1:] & ~first[1:])
    out[tail] = True
    led = tail[space[tail]] + 1
    out[led] = False
    # Contractions: an apostrophe, not led by a space, and lower-case letters.
    mark = np.flatnonzero((cps == 39) & out[:n])
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1]]
    if len(mark):
        one = cps[mark + 1]
        two = cps[np.minimum(mark + 2, n - 1)]
        has = (mark + 2 < n) & ~first[np.minimum(mark + 2, n)]
        short = np.isin(one, [ord(x) for x in "stmd"])
        pair = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= has & (one == ord(a)) & (two == ord(b))
        for hit, width in ((short, 2), (pair, 3)):
            m = mark[hit]
            out[m + 1] = False
            out[m + width] |= True
        # what follows a contraction keeps its start even where a space came before it
    return np.flatnonzero(out[:n])


class Encoded(NamedTuple):
    """Token ids of many texts in one pool; text k has ids[at[k]:at[k + 1]]."""

    ids: np.ndarray
    at: np.ndarray


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the slices that begin at begin, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Coder:
    """Encodes and decodes by one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        words = [b""] * self.size
        for w, r in ranks.items():
            words[r] = w
        self.word_size = np.array([len(w) for w in words], np.int64)
        self.word_at = np.cumsum(self.word_size) - self.word_size
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way in which two tokens make a third.
        joins = {}
        for w, r in ranks.items():
            for k in range(1, len(w)):
                a, b = ranks.get(w[:k]), ranks.get(w[k:])
                if a is not None and b is not None:
                    joins[a * self.size + b] = r
        self.joins = joins
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        self.forget()

    def forget(self):
        """Empties the cache."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.pool, self.pool_n = np.zeros(1 << 16, np.int32), 0
        self.piece_at, self.piece_n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.join_keys, keys), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == keys, self.join_ids[at], self.size)

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right, joins, size = list(range(-1, n - 1)), list(range(1, n + 1)), self.joins, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := joins.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (x := joins.get(r * size + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (k := left[i]) >= 0 and (x := joins.get(ids[k] * size + r)) is not None:
                heapq.heappush(heap, (x, k, ids[k], r))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), size)
        done_ids, done_own = [], []
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        hit = whole >= 0
        done_ids.append(whole[hit])
        done_own.append(np.flatnonzero(hit))
        for k in np.flatnonzero(~hit & (size > LONG)).tolist():
            done_ids.append(np.array(self._merge_long(pieces[k]), np.int64))
            done_own.append(np.full(len(done_ids[-1]), k))
        keep = (~hit & (size <= LONG))[own]
        ids, own = ids[keep], own[keep]
        rank = self._pairs(ids, own)
        while len(ids):
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.minimum.reduceat(rank, head)
            if (best == self.size).any():  # these pieces are finished
                stop = np.repeat(best == self.size, np.diff(np.append(head, len(ids))))
                done_ids.append(ids[stop])
                done_own.append(own[stop])
                ids, own, rank = ids[~stop], own[~stop], rank[~stop]
                continue
            at = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(head, len(ids)))))
            at = at[np.append(True, own[at][1:] != own[at][:-1])]  # the leftmost of each piece
            ids[at] = rank[at]
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            moved = at - np.arange(len(at))
            ids, own, rank = ids[gone], own[gone], rank[gone]
            for x in (moved, moved[moved > 0] - 1):
                nxt = np.minimum(x + 1, len(ids) - 1)
                rank[x] = np.where((x + 1 < len(ids)) & (own[nxt] == own[x]), self._rank(ids[x] * self.size + ids[nxt]), self.size)
        all_ids, all_own = np.concatenate(done_ids), np.concatenate(done_own)
        order = np.argsort(all_own, kind="stable")
        return all_ids[order], np.bincount(all_own, minlength=len(pieces))

    def _pairs(self, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), self.size, np.int64)
        if len(ids) > 1:
            rank[:-1] = np.where(own[1:] == own[:-1], self._rank(ids[:-1] * self.size + ids[1:]), self.size)
        return rank

    def _learn(self, pieces: list[str]):
        """Adds pieces that aren't known to the cache."""
        ids, n = self.merge([p.encode() for p in pieces])
        base = len(self.known)
        while self.pool_n + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while base + len(pieces) > len(self.piece_at):
            self.piece_at, self.piece_n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.piece_at, self.piece_n))
        self.pool[self.pool_n : self.pool_n + len(ids)] = ids
        self.piece_at[base : base + len(pieces)] = self.pool_n + np.cumsum(n) - n
        self.piece_n[base : base + len(pieces)] = n
        self.pool_n += len(ids)
        self.known.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.held += sum(map(len, pieces)) + _PIECE * len(pieces)

    def encode(self, texts: pa.Array) -> Encoded:
        cps, at, joined = codepoints(texts)
        begin = starts(cps, at)
        bounds = [*begin.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        size = self.piece_n[which]
        ids = self.pool[_spread(self.piece_at[which], size)]
        if self.held > CACHE:
            self.forget()
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return Encoded(ids, ends[np.searchsorted(begin, at)])

    def decode(self, encoded: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, where each text starts, and where each token starts in them."""
        size = self.word_size[encoded.ids]
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        return self.word_bytes[_spread(self.word_at[encoded.ids], size)], offsets[encoded.at], offsets

    def encode_one(self, text: str) -> list[int]:
        return self.encode(pa.array([text], pa.string())).ids.tolist()


def coder(path: str) -> Coder:
    """The coder of a rank file, made once in a process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _with_coder(path: str, body: Callable) -> Callable:
    """body(coder, batches) as a function over batches, which leaves no cache behind."""

    def run(batches):
        own = coder(path)
        try:
            yield from body(own, batches)
        finally:
            own.forget()

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with all their columns and ``ids``, the token ids of the text (array of int)."""
    kept = [c for c in docs.columns if c != "ids"]

    def run(own, batches):
        for b in text_slices(batches, text_col):
            got = own.encode(b.column(kept.index(text_col)))
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(pa.array(got.at, pa.int32()), pa.array(got.ids, pa.int32()))], names=[*kept, "ids"])

    return arrow_map(docs.select(kept), _with_coder(path, run), T.StructType([*docs.select(kept).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with all their columns and ``decoded`` (binary) and ``offsets`` (byte offset of each token's end)."""
    kept = [c for c in tokens.columns if c not in ("decoded", "offsets")]

    def run(own, batches):
        for b in batches:
            lists = b.column(kept.index(ids_col))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.zeros(len(lists) + 1, np.int64)
            np.cumsum([len(x) if x is not None else 0 for x in lists], out=at[1:])
            data, begin, offsets = own.decode(Encoded(flat, at))
            raw = data.tobytes()
            yield pa.record_batch([*b.columns, pa.array([raw[s:e] for s, e in zip(begin[:-1], begin[1:], strict=True)], pa.binary()), pa.array([offsets[s + 1 : e + 1] - offsets[s] for s, e in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64()))], names=[*kept, "decoded", "offsets"])

    schema = T.StructType([*tokens.select(kept).schema, T.StructField("decoded", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.LongType()))])
    return arrow_map(tokens.select(kept), _with_coder(path, run), schema)


def tokenize(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with all their columns and ids, n_tokens, and lossless: whether the ids decode to the text."""
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "lossless")]

    def run(own, batches):
        for b in text_slices(batches, text_col):
            texts = b.column(kept.index(text_col))
            got = own.encode(texts)
            data, begin, _ = own.decode(got)
            raw = data.tobytes()
            same = [raw[s:e] == (t or "").encode() for s, e, t in zip(begin[:-1].tolist(), begin[1:].tolist(), texts.to_pylist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(got.at, pa.int32()), pa.array(got.ids, pa.int32()))
            yield pa.record_batch([*b.columns, ids, pa.array(np.diff(got.at)), pa.array(same)], names=[*kept, "ids", "n_tokens", "lossless"])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]
    return arrow_map(docs.select(kept), _with_coder(path, run), T.StructType([*docs.select(kept).schema, *more]))


def _sha(parts: Iterator[bytes]) -> list[str]:
    return [hashlib.sha256(p).hexdigest() for p in parts]


def digest(docs: DataFrame, path: str) -> DataFrame:
    """By document its number of tokens, and digests of its ids and of what they decode to."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(own, batches):
        text = [f" {i}" for i in range(own.size)]
        for b in text_slices(batches):
            got = own.encode(b.column(1))
            words, cuts = got.ids.tolist(), got.at.tolist()
            written = ("".join(map(text.__getitem__, words[s:e]))[1:].encode() for s, e in zip(cuts[:-1], cuts[1:], strict=True))
            ids_sha = _sha(written)
            data, begin, _ = own.decode(got)
            raw, begin = data.tobytes(), begin.tolist()
            decoded_sha = _sha(raw[s:e] for s, e in zip(begin[:-1], begin[1:], strict=True))
            yield pa.record_batch([b.column(0), pa.array(np.diff(got.at)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=names)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _with_coder(path, run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
