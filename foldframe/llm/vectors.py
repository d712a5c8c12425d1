"""Vectors in Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def valid_rows(column: pa.Array, zero: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension among the usable vectors of a list column, in its own
    precision.  Null, empty and (unless ``zero``) zero vectors and those with null or non-finite
    components are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()  # leaves out the places of null lists
    values = np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False))
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1) & (x.any(axis=1) | zero)
        if good.any():
            yield rows[good], np.ascontiguousarray(x[good])


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms in double precision, also where squares would leave its range."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
