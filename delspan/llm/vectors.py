"""What the vector operators share: which vectors count, and columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrices(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as doubles) for each vector length in the column."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.asarray(column.value_lengths())
    ends = np.cumsum(sizes)
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]))
    return out
