"""Vectors as fixed-point integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vec: Column) -> Column:
    """Whether a vector is there and all its components are numbers: none null, NaN or infinite."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def fixed(vec: Column, scale: int, bits: int, offset: int = 0) -> Column:
    """Components as longs floor(scale * x) + offset, x as double; one of 2**bits or more in magnitude raises, as results in longs could overflow."""
    wide = F.raise_error(F.lit(f"a vector component is too large: |{scale} x| has to stay below 2^{bits}"))

    def whole(x):
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < float(1 << bits), F.floor(y).cast("long") + F.lit(offset).cast("long")).otherwise(wide.cast("long"))

    return F.transform(vec, whole)


def rows_of(column: pa.ChunkedArray | pa.ListArray, dims: int) -> np.ndarray:
    """An Arrow column of number lists as a matrix; a list of fewer than ``dims`` is filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(column) and (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def lists_of(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as an Arrow column of lists."""
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(matrix).ravel(), kind))
