"""Vectors of an Arrow list column, kept within the range of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1; no rounding, and no square overflows or vanishes."""
    if not x.size:
        return x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column whose lists are equally long, as scaled doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return scaled(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``; both scaled."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
