"""What the vector operators share: valid rows, blocks of vectors, and reading them in a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def is_valid(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample_matrix(rows: DataFrame, vector: str, key: str, limit: int) -> np.ndarray:
    """At most ``limit`` vectors, chosen by the hash of their key, as the driver's matrix."""
    got = rows.orderBy(F.xxhash64(key), key).select(vector).limit(limit).collect()
    return np.array([r[0] for r in got], dtype=np.float64)


def matrix(column, rows: slice | None = None) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)
