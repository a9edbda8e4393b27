"""Helpers for operators that cross into Python by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def list_of(values: np.ndarray, lengths: list[int] | np.ndarray) -> pa.ListArray:
    """A list column from its flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def small_batches(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most most_bytes of text each (a single longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        block = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def each_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch], text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f as a function for mapInArrow, over batches of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            yield f(batch)

    return run
