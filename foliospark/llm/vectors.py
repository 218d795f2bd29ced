"""Vectors in Arrow columns as matrices, and the columns that make them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; short lists are filled up with zeros, and components beyond
    ``width`` (by default the longest list) are cut off."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    most = int(sizes.max(initial=0))
    if most and (sizes == most).all():
        out = values.reshape(len(sizes), most)
    else:
        out = np.zeros((len(sizes), most), values.dtype)
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    if width is None or width == most:
        return out
    if width < most:
        return out[:, :width]
    return np.pad(out, ((0, 0), (0, width - most)))


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def finite(vector: str) -> tuple[Column, Column]:
    """The components as double, and whether the vector takes part: it is not null and holds
    no null and no infinite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x, F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; a shorter vector counts as filled up with zeros."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
