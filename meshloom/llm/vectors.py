"""Vectors in Arrow tables, and which of them take part in a search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """True for a vector with a component other than zero and none null, NaN or infinite; false for null."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(col, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as a matrix of doubles; minus zero becomes zero."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) + 0.0


def folded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the first of each distinct row, each row's distinct number, and the numbers' sizes."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, group, size = np.unique(raw, return_index=True, return_inverse=True, return_counts=True)
    return first, group, size
