"""Vectors as whole numbers, for the operators that need exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 62                          # a component saturates here
LONG_MAX = (1 << 63) - 1                   # and a result here


def whole(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def floors(column: pa.ListArray, factor: int, width: int) -> np.ndarray:
    """(row, component) array of floor(factor * x); rows shorter than ``width`` go on with zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    # the double next below the limit, as the limit itself cannot be left when cast
    values = np.clip(x, -float(LARGEST), np.nextafter(float(LARGEST), 0)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of an array as one binary value each."""
    raw = np.ascontiguousarray(rows)
    size = raw.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def largest(*arrays: np.ndarray) -> int:
    """Largest absolute value."""
    return max([1] + [max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size])


def products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with one vector; a result that no long holds saturates."""
    if largest(rows) * largest(one) * max(1, len(one)) <= LONG_MAX:
        return rows @ one
    return np.clip(rows.astype(object) @ one.astype(object), -LONG_MAX - 1, LONG_MAX).astype(np.int64)


def squares(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one vector or to as many; a result that no long holds saturates."""
    if (largest(rows) + largest(one)) ** 2 * max(1, rows.shape[1]) <= LONG_MAX:
        gap = rows - one
        return (gap * gap).sum(axis=1)
    gap = rows.astype(object) - one.astype(object)
    return np.clip((gap * gap).sum(axis=1), 0, LONG_MAX).astype(np.int64)


def widest(rows: DataFrame, vector: str) -> tuple[int, int]:
    """Number of rows and length of the longest vector."""
    found = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    return found["n"], found["d"] or 0
