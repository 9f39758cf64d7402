"""Small helpers for kernels that stream Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def same_as_next(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """For each row but the last: does the next row hold the same value (null equals null)?"""
    n = len(column)
    if n < 2:
        return np.zeros(0, dtype=bool)
    return null_safe_equal(column.slice(0, n - 1), column.slice(1, n - 1))


def null_safe_equal(a, b) -> np.ndarray:
    equal = pc.fill_null(pc.equal(a, b), False)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.asarray(pc.or_(equal, both).to_numpy(zero_copy_only=False), dtype=bool)


def conform(batch: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    return batch.cast(schema).combine_chunks().to_batches()
