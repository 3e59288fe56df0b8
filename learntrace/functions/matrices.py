"""Matrices from array columns of Arrow batches and back, without a Python object a value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix of doubles; rows of unequal lengths or nulls are a ValueError."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if column.null_count or len(column) and (len(values) % len(column) or (np.diff(column.offsets.to_numpy()) != len(values) // len(column)).any()):
        raise ValueError("rows of an array column differ in length or are null")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array column; a vector stays a plain column."""
    if x.ndim == 1:
        return pa.array(x)
    x = np.ascontiguousarray(x.reshape(len(x), -1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
