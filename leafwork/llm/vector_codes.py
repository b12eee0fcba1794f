"""Compression of vectors into codes of few bytes: product codebooks fitted by Yinyang Lloyd.

Components become integers, floor(scale * x), and vectors are cut into equal parts. Every part has a
codebook, at first that part of the first vectors. A round assigns each part to its nearest entry and
replaces entries by the means of what they got. A vector keeps for each part an upper bound of the
distance to its entry and one lower bound for each group of entries; when entries move, bounds follow by
how far they moved, and only groups whose bound no longer excludes them are scanned. All that bounds
leave open is decided on integers, so codes are those of plain Lloyd, ties going to the lower index.

State between rounds is a table of the shared folder: bounds and entries beside the integers. A task adds
up what its rows give to the next codebooks and writes one row of sums, so that no vector is shuffled.
What reaches the driver has the size of the codebooks, whatever the number of vectors.

Edge cases: vectors that are null, or hold null or non-finite components, or components that scale beyond
2**22, get no code; neither do those of another length than the vector of the smallest id. Vectors are
filled up with zeros to a multiple of the number of parts. Ids that repeat keep all rows; of rows with one
id the smaller vector comes first among the first vectors; null ids come last. An empty table gives no
rows and empty codebooks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, saved
from .textarrays import arrow_map

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that share a lower bound.
GROUP = 8
#: Scaled components stay below this, so that squared distances are exact.
LARGEST = 1 << 22
_STATE = "id long, label int, v array<int>, entry binary, upper array<float>, lower array<float>, sums array<long>, counts array<long>"


@dataclass
class Compressed:
    """Codes (id, label, codes: a byte for each part, error) and the codebooks, (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """Checksum of all components, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """The usable vectors: id, label, v."""
    v = F.transform(vector_col, lambda x: x.cast("double") * scale)
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST)))
    own = vectors.where(F.coalesce(F.col(vector_col).isNotNull() & fits, F.lit(False)))
    return own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.transform(v, lambda x: F.floor(x).cast("int")).alias("v"))


def first_vectors(ints: DataFrame, entries: int) -> list[list[int]]:
    """Vectors of the smallest ids, all of the length of the first."""
    for _ in range(2):
        rows = ints.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
        width = len(rows[0]["v"]) if rows else 0
        if all(len(r["v"]) == width for r in rows):
            break
        ints = ints.where(F.size("v") == width)
    return [r["v"] for r in rows]


def grouped(entries: np.ndarray, size: int = GROUP) -> np.ndarray:
    """A group for each entry: a few rounds of k-means over the codebook, from entries spread by their length."""
    k = max(1, len(entries) // size)
    x = entries.astype(np.float64)
    order = np.argsort((x**2).sum(1), kind="stable")
    centre = x[order[(np.arange(k) * len(x)) // k]]
    for _ in range(5):
        group = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(k):
            if (group == g).any():
                centre[g] = x[group == g].mean(0)
    return group


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to all entries, exact."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


@dataclass
class Part:
    """One part's codebook, the groups of its entries, and how far each entry has moved since bounds were taken."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(self.group.max() + 1)]

    def first(self, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, upper and lower bounds of parts that have none yet."""
        d, row = squares(x, self.entries), np.arange(len(x))
        entry = d.argmin(1)
        far = np.sqrt(d.astype(np.float64))
        upper = far[row, entry].copy()
        far[row, entry] = np.inf
        lower = np.full((len(x), groups), np.inf)
        for g, own in enumerate(self.members):
            if len(own):
                lower[:, g] = far[:, own].min(1)
        return entry, _up(upper), _down(lower)

    def again(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the entries moved, and how many distances were taken."""
        members, n_entries = self.members, len(self.entries)
        entry, upper, lower = entry.copy(), upper + self.moved[entry], lower.astype(np.float64)
        for g, own in enumerate(members):
            lower[:, g] -= self.moved[own].max(initial=0.0)
        slack = 1e-6 * (1 + upper)
        open_ = np.flatnonzero(upper + slack >= lower.min(1))
        diff = x[open_] - self.entries[entry[open_]]
        own2 = (diff * diff).sum(1)
        upper[open_] = np.sqrt(own2.astype(np.float64))
        fails = upper[open_, None] + slack[open_, None] >= lower[open_]
        best, taken = own2 * n_entries + entry[open_], len(open_)
        low = np.full((*fails.shape, 2), np.iinfo(np.int64).max)
        for g, own in enumerate(members):
            r = np.flatnonzero(fails[:, g])
            if len(r) and len(own):
                key = squares(x[open_[r]], self.entries[own]) * n_entries + own
                low[r, g, : min(2, len(own))] = np.partition(key, min(1, len(own) - 1), axis=1)[:, :2]
                best[r] = np.minimum(best[r], low[r, g, 0])
                taken += key.size
        new, was = best % n_entries, entry[open_]
        # a scanned group is bounded by its nearest entry that isn't the chosen one
        bound = np.where(low[:, :, 0] == best[:, None], low[:, :, 1], low[:, :, 0])
        bound = np.where(bound == np.iinfo(np.int64).max, np.inf, np.sqrt((bound // n_entries).astype(np.float64)))
        # a group that wasn't scanned gets the entry that was left
        rows, left = np.arange(len(open_)), np.where(new != was, np.sqrt(own2.astype(np.float64)), np.inf)
        rest = lower[open_]
        rest[rows, self.group[was]] = np.minimum(rest[rows, self.group[was]], left)
        lower[open_] = np.where(fails, bound, rest)
        entry[open_], upper[open_] = new, np.sqrt((best // n_entries).astype(np.float64))
        return entry, _up(upper), _down(lower), taken


def _lists(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def assign(table: DataFrame, parts: list[Part], bounds: bool, last: bool) -> DataFrame:
    """Entries for all rows: state for the next round with the task's sums, or the codes and errors."""
    groups = max(int(p.group.max()) + 1 for p in parts)
    k, (n_entries, width) = len(parts), parts[0].entries.shape

    def run(batches):
        sums, counts = np.zeros((k, n_entries, width), np.int64), np.zeros((k, n_entries), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            own = _matrix(b.column(2), n)
            x = np.zeros((n, k * width), np.int64)
            x[:, : own.shape[1]] = own
            entry, upper, lower = np.zeros((n, k), np.uint8), np.zeros((n, k), np.float32), np.zeros((n, k, groups), np.float32)
            if bounds:
                entry = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, k).copy()
                upper, lower = _matrix(b.column(4), n).copy(), _matrix(b.column(5), n).reshape(n, k, groups).copy()
            error = np.zeros(n, np.int64)
            for p, part in enumerate(parts):
                y = x[:, p * width : (p + 1) * width]
                if bounds:
                    entry[:, p], upper[:, p], lower[:, p], _ = part.again(y, entry[:, p].astype(np.int64), upper[:, p], lower[:, p])
                else:
                    entry[:, p], upper[:, p], lower[:, p] = part.first(y, groups)
                if last:
                    d = y - part.entries[entry[:, p]]
                    error += (d * d).sum(1)
                else:
                    np.add.at(sums[p], entry[:, p], y)
                    counts[p] += np.bincount(entry[:, p], minlength=n_entries)
            if last:
                yield pa.record_batch([b.column(0), b.column(1), _bytes(entry), pa.array(error)], names=["id", "label", "codes", "error"])
            else:
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), _bytes(entry), _lists(upper, pa.float32()), _lists(lower.reshape(n, -1), pa.float32()), none, none], names=[f.split()[0] for f in _STATE.split(", ")])
        if not last and counts.any():
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32())]
            yield pa.record_batch([*(pa.nulls(1, t) for t in kinds), _lists(sums.reshape(1, -1), pa.int64()), _lists(counts.reshape(1, -1), pa.int64())], names=[f.split()[0] for f in _STATE.split(", ")])

    return arrow_map(table, run, "id long, label int, codes binary, error long" if last else _STATE)


def _total(state: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums over the tasks' rows, place by place."""
    rows = state.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["at"]] = r["x"]
    return out


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> Compressed:
    """Codes for all usable vectors, after some rounds of Lloyd from the first vectors' parts."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: between 1 and 256 entries")
    ints = integers(vectors, id_col, vector_col, label_col, scale)
    first = first_vectors(ints, entries)
    if not first:
        return Compressed(ints.select("id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")).where("false"), np.zeros((parts, 0, 0), np.int64))
    long = len(first[0])
    width = max(1, -(-long // parts))
    if width * entries > 1 << 16:
        raise ValueError("vectors are too long for exact distances: use more parts")
    start = np.zeros((len(first), parts * width), np.int64)
    start[:, :long] = first
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    groups = [grouped(b) for b in books]
    still, state = np.zeros(books.shape[1]), None
    codebook = [Part(b, g, still) for b, g in zip(books, groups, strict=True)]
    table = ints.where(F.size("v") == long)
    for _ in range(rounds):
        before, state = state, saved(assign(state.where("v is not null") if state is not None else table, codebook, state is not None, False), "codes")
        dropped(before)
        sums = _total(state, "sums", books.size).reshape(books.shape)
        counts = _total(state, "counts", books[:, :, 0].size).reshape(books.shape[:2])
        new = np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), books)
        moved = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
        books, codebook = new, [Part(b, g, m) for b, g, m in zip(new, groups, moved, strict=True)]
    rows = saved(assign(state.where("v is not null") if state is not None else table, codebook, state is not None, True), "codes")
    dropped(state)
    return Compressed(rows, books)


def decode(codes: bytes, codebooks: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """The vector that a code stands for, from the middles of the integers' steps."""
    return (codebooks[np.arange(len(codes)), np.frombuffer(codes, np.uint8)].ravel() + 0.5) / scale


def digest(found: Compressed) -> DataFrame:
    """vec_id, code in hexadecimal, error, the error of all rows of the same label, checksum of the codebooks."""
    rows = found.rows
    # Written first, its size is known: Spark broadcasts few labels, and splits a hot one's rows where there are many.
    totals = saved(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "errors")
    both = rows.join(totals, rows["label"].eqNullSafe(totals["of"]), "left")
    return both.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _rounds() -> str:
    """SQL of the assignments and codebooks of all rounds."""
    near = "a{k} AS (SELECT vec_id, label, p, v, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (SELECT x.*, c.e, list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT AS d FROM parts x JOIN c{k} c USING (p)) GROUP BY ALL)"
    mean = """m{k} AS (SELECT p, e, list(CAST(y AS BIGINT) ORDER BY i) AS v FROM (SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) / count(*) AS y
  FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e), c{n} AS (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))"""
    out = []
    for k in range(ROUNDS):
        out += [near.format(k=k), mean.format(k=k, n=k + 1)]
    return ", ".join([*out, near.format(k=ROUNDS)])


ORACLE = f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
parts AS (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS v FROM (SELECT *, len(v) // {PARTS} AS w, unnest(range({PARTS})) AS p FROM kept)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {ENTRIES}),
{_rounds()},
sha AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(v, ',') AS t FROM c{ROUNDS})),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, sha
"""
