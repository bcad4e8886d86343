"""Rows of vectors: which take part, whole-number entries, and matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(column: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def floored(column: str, scale: float, bound: int) -> Column:
    """floor(scale * c) of each entry c, as long; what lies beyond ``bound`` either way is set to it."""
    return F.transform(column, lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(scale)), F.lit(float(-bound))), F.lit(float(bound)))))


def usual_length(rows: DataFrame, column: str) -> int:
    """The commonest length of the vectors, of several the greatest; 0 without rows."""
    found = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A list column, all of ``width`` entries and without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as a list column, a row for each."""
    flat = np.ascontiguousarray(values).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, values.shape[1]))[: len(values) + 1], pa.int32()), pa.array(flat))
