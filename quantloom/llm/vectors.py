"""Shared pieces of the operators on vectors: usable rows, integer components, batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components up to this size keep squared distances of 64 components, and 100 times an inner product, in a long.
LARGEST = 2**24


def usable(vec: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine, F.lit(False))


def whole_numbers(vec: Column, scale: int = 256) -> Column:
    """Each component x as the integer floor(scale * x); an error where one is beyond ``LARGEST``, as sums of products of
    such integers don't fit in a long."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) <= LARGEST, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}")).cast("int")
        )

    return F.transform(vec, one)


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


def numbers(column: pa.Array, null: int = 2**63 - 1) -> np.ndarray:
    """A column of longs; ``null`` stands for a null."""
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (int64) of the rows of two matrices of integers: in floating point where no sum can leave the
    integers that a double holds, else in longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if largest < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def rows_of(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec) of a table of vectors, without its other columns."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
