"""Helpers over Arrow columns in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    n = len(col)
    if n < 2:
        return np.zeros(0, bool)
    ne = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), True)
    null = np.asarray(pc.is_null(col))
    return np.asarray(ne) & ~(null[1:] & null[:-1])


def starts(tab: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each stretch of equal keys."""
    new = np.zeros(max(0, tab.num_rows - 1), bool)
    for k in keys:
        new |= changes(tab[k])
    return np.r_[0, np.flatnonzero(new) + 1]
