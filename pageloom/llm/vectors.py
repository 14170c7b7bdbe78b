"""Vectors as arrays of whole numbers: which rows take part, scaling, matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_sound(vector: Column) -> Column:
    """Not null and without a null or non-finite component."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def scaled(vector: Column, factor: int, shift: int = 0) -> Column:
    """floor(factor * c) + shift for each component c, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")) + F.lit(shift).cast("long"))


def dimension(vectors: DataFrame, vector: str) -> int:
    """Components of the longest vector."""
    return vectors.agg(F.max(F.size(vector))).first()[0] or 0


def padded(vector: Column, dims: int, value: int) -> Column:
    """Shorter vectors get ``value`` at their end."""
    fill = F.array_repeat(F.lit(value).cast("long"), F.lit(dims) - F.size(vector))
    return F.when(F.size(vector) < dims, F.concat(vector, fill)).otherwise(vector)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of an Arrow column of equally long lists as an array of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
