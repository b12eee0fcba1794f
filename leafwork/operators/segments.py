"""Groups of rows as segments of arrays: many pages, lines or documents in one call, none in more than one.

Rows come dealt and sorted by their keys, so a group is a run of rows. What a worker holds is a batch and the group
that goes on in the next one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def differs(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value is another than the one in front of it; two nulls are the same."""
    first = pa.array([before.as_py() if before is not None else None], column.type)
    shifted = pa.concat_arrays([first, column.slice(0, max(0, len(column) - 1))])
    same = pc.or_(pc.fill_null(pc.equal(column, shifted), False), pc.and_(pc.is_null(column), pc.is_null(shifted)))
    return ~same.to_numpy(zero_copy_only=False)


def starts(batch: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None = None) -> np.ndarray:
    """Whether each row begins a group, the first one compared with the last row of the batch before."""
    out = np.zeros(batch.num_rows, bool)
    for k in keys:
        out |= differs(batch.column(k), before.column(k)[-1] if before is not None else None)
    if before is None and len(out):
        out[0] = True
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that hold groups as a whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        begins = np.flatnonzero(starts(b, keys, held[-1] if held else None))
        if len(begins) and (held or begins[-1]):
            yield pa.Table.from_batches([*held, b.slice(0, begins[-1])]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(begins[-1]) if len(begins) else b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_slices(batch: pa.RecordBatch, keys: list[str], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut where a group begins, each part with ``most`` bytes of a text column or little more, or one group."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = np.flatnonzero(starts(batch, keys))
    part = np.append(0, size)[begins] // most
    cut = begins[np.flatnonzero(np.diff(part, prepend=-1))].tolist()
    for a, z in zip(cut, [*cut[1:], batch.num_rows], strict=True):
        yield batch.slice(a, z - a)


def by_group(rows: DataFrame, keys: list[str], order: list[str | Column], run, schema) -> DataFrame:
    """A function of (batch, segment of each row) over whole groups, sorted within; it yields or returns a batch."""

    def each(batches):
        for b in whole_groups(batches, keys):
            yield run(b, np.cumsum(starts(b, keys)) - 1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def heads(segment: np.ndarray) -> np.ndarray:
    """Where each segment starts, for segments in order."""
    return np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.zeros(0, np.int64)


def running_max(segment: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The largest value so far within each segment; segments are numbered in order."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    # ranks of a later segment lie above all of an earlier one, so one running maximum serves all
    reach = np.maximum.accumulate(segment.astype(np.int64) * len(x) + rank) if len(x) else rank
    return x[order[reach - segment * len(x)]] if len(x) else x
