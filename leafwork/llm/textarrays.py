"""Vectorised views of Arrow text columns: code points, words and word shingles.

Everything works on slices of bounded bytes, so a task's memory does not grow with its
partition. A single longer text forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1_000_000
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = np.random.default_rng(77).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * _U(2) + _U(1)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def release() -> None:
    """Gives free memory back to the system; a worker waits beside others once its task is done."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(run: Callable) -> Callable:
    """The function over batches, releasing memory when its task ends."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


#: Bytes of a batch that Spark hands to a worker, where the session keeps to Spark's own bound: several
#: batches are held at once, by the executor and by the worker.
BATCH_BYTES = 8 << 20
_BOUND, _USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """A function over Arrow batches of bounded size, which leaves no memory behind in its worker."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND) == f"{_USUAL}b":
        conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(tidied(run), schema)


def text_slices(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each hold at most ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text starts; nulls are empty."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4))
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), at
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], at


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """All code points of a string array, where each text starts, and the joined text."""
    data, _ = utf8(texts)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), out=at[1:])
    joined = data.tobytes().decode("utf-8")
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), at, joined


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text, and the first word and words of each text.

    A word is a run without blanks (0x20, 0x09-0x0D); only A-Z are lower-cased.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64), none
    blank = _SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    edge = at[:-1][at[:-1] < n]
    first[edge] = ~blank[edge]
    last = ~blank
    last[:-1] &= blank[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = ~blank[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers_to(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * up[:n], out=run[1:])
    words = mix((run[e + 1] - run[s]) * down[s] + (e - s).astype(np.uint64))
    begin = np.searchsorted(s, at)
    return words, begin[:-1], s


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text of fewer than five words has one shingle, its whole sequence; one without words has none.
    """
    data, at = utf8(texts)
    words, begin, _ = word_hashes(data, at)
    total = len(words)
    begin = np.append(begin, total)
    full = np.zeros(max(0, total - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        full += words[j : j + len(full)] * _STEP[j]
    full = mix(full)
    for k in range(len(begin) - 1):
        a, b = int(begin[k]), int(begin[k + 1])
        if b - a >= SHINGLE:
            x = np.sort(full[a : b - SHINGLE + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            yield x[keep]
        elif b > a:
            own = (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + _STEP[SHINGLE :] * _U(b - a)
            yield mix(own)
        else:
            yield np.zeros(0, np.uint64)


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of every maximal run of bytes inside; no run crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] = inside[edge]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from s to e, e included, as they are."""
    n = len(data)
    up, down = _powers_to(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=run[1:])
    return mix((run[e + 1] - run[s]) * down[s] + (e - s).astype(np.uint64))


def blank(data: np.ndarray) -> np.ndarray:
    """Whether each byte is one of 0x20 and 0x09-0x0D."""
    return _SPACE[data]
