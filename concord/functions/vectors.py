"""Vector column expressions (JVM) and Arrow kernels (NumPy inside tasks).

Vectors are ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``; all arithmetic is in DOUBLE.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Similarities are rounded to this many decimals before they are ranked, so equal
# vectors tie exactly whatever block they were multiplied in, and the id decides.
SIM_DIGITS = 9


def squared_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(squared_norm(vec))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; a zero vector is returned unchanged (divisor 1).

    The division sits in the aggregate's finish step so the norm is computed
    once per row, not once per element.
    """

    def finish(total: Column) -> Column:
        divisor = F.when(total == 0, F.lit(1.0)).otherwise(F.sqrt(total))
        return F.transform(vec, lambda v: v.cast("double") / divisor)

    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"), finish)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column -> (rows, dims) float64 matrix, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1)


def vectors(values: np.ndarray) -> pa.Array:
    """(rows, dims) matrix -> Arrow list<double> column."""
    rows, dims = values.shape
    offsets = np.arange(0, rows * dims + 1, dims, dtype=np.int32) if dims else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def unit_rows(values: np.ndarray) -> np.ndarray:
    norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return values / norms


@F.arrow_udf(T.DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((matrix(a) * matrix(b)).sum(axis=1) if len(a) else np.zeros(0))


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array(np.zeros(0))
    return pa.array((unit_rows(matrix(a)) * unit_rows(matrix(b))).sum(axis=1))


@F.arrow_udf(T.DoubleType())
def euclidean(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array(np.zeros(0))
    gap = matrix(a) - matrix(b)
    return pa.array(np.sqrt((gap * gap).sum(axis=1)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def confidence(distance: Column) -> Column:
    """1 / (1 + distance to the own centroid)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unit(a: pa.Array) -> pa.Array:
    """Arrow form of :func:`l2_normalize` for bulk columns."""
    return vectors(unit_rows(matrix(a))) if len(a) else pa.array([], pa.list_(pa.float64()))
