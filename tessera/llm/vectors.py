"""Columns of vectors as whole numbers in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_vectors(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, sizes, values): which rows are vectors without null or non-finite components, the sizes of all rows, and floor(scale * x) of the valid rows' components, one after another.

    The values are doubles that hold whole numbers; for a scale that is a power of two they are exact.
    """
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
    row = np.repeat(np.arange(len(sizes)), sizes)
    valid[row[~np.isfinite(x)]] = False
    return valid, sizes, x[valid[row]]
