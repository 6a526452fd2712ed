"""Vectors that take part in search and de-duplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null or empty, all components finite, at least one of them not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def of_common_size(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows whose vector has the most frequent length (ties: the longest), and that length; 0 if none."""
    first = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = int(first["n"]) if first else 0
    return rows.where(F.size(column) == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def from_binary(values, size: int) -> np.ndarray:
    """float64 rows from an iterable of their bytes."""
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(-1, size)


def to_binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows, dtype="<f8")
    width = data.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products whose rounding doesn't depend on a row's place."""
    return (a * b).sum(axis=1)
