"""Vectors as whole numbers: which rows take part, and their batches as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import numpy as np
import pyarrow as pa

LIMIT = float(1 << 40)  # images of larger components would not leave room for sums in longs


def whole(column: str, scale: int, shift: int = 0) -> Column:
    """array<long> of floor(scale * c) + shift; NULL where the vector does not take part: it is NULL or
    empty, or holds a NULL, a component that is not finite, or one beyond LIMIT."""
    entry = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift)
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LIMIT))
    return F.when(F.size(column) > 0, F.when(~bad, F.transform(column, lambda c: entry(c).cast("long"))))


def of_one_length(rows: DataFrame, column: str = "x") -> tuple[DataFrame, int]:
    """The rows whose vectors have the commonest length (the larger of two as common), and that length; 0 without rows.
    Vectors of other lengths have no distance or product with them and take no part."""
    sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return (rows.where(F.size(column) == sizes[0].d), int(sizes[0].d)) if sizes else (rows, 0)


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """len(lists) x d of a batch of arrays of d longs."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), d)


def arrays(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1)))
