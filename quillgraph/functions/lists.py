"""Columns of lists in Arrow batches as flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32")), values)


def flat(c: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of every value, and the values, of a column of lists."""
    return np.repeat(np.arange(len(c)), pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)), c.flatten()
