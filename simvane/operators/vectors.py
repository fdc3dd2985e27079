"""Vector columns: dimension checks, and Arrow batches as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simvane.errors import DimensionMismatch, EmptyIndex, VectorIndexError


def dimension(df: DataFrame, column: str = "embedding", empty: str = "error") -> int:
    """The one dimension of a vector column. Nulls, null components and mixed lengths raise; so does no row, or it is 0."""
    bad = F.col(column).isNull() | F.exists(F.col(column), lambda x: x.isNull())
    size = F.size(column)
    row = df.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).first()
    if row["low"] is None:
        if empty == "error":
            raise EmptyIndex("no vectors")
        return 0
    if row["bad"]:
        raise VectorIndexError(f"{row['bad']} rows hold a null vector or component")
    if row["low"] != row["high"]:
        raise DimensionMismatch(row["high"], row["low"])
    if row["low"] == 0:
        raise VectorIndexError("vectors need one component at least")
    return row["low"]


def check_dimension(expected: int, queries: DataFrame, column: str = "embedding") -> None:
    got = dimension(queries, column, empty="allow")
    if got not in (0, expected):
        raise DimensionMismatch(expected, got)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of vectors of one dimension as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def listed(values: np.ndarray) -> pa.Array:
    """A matrix as a list column of doubles."""
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(np.ascontiguousarray(values, np.float64).ravel()))
