"""Slices of Arrow batches that are bounded by rows and by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 500, 8 << 20


def blocks(batch: pa.RecordBatch, column: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most `rows` rows whose values in a column of texts or bytes take at most `size` bytes together; a
    longer value is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to
