"""Embeddings as integer vectors, and exact inner products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import named

#: Vectors whose squared length reaches this take no part: below it every inner product fits a long.
LONGEST = float(1 << 62)


def finite(vector: Column) -> Column:
    """False for a null vector, and for one that holds a null, a NaN or an infinity."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integer_rows(df: DataFrame, id_col: str, vector_col: str, factor: int, *more: Column) -> DataFrame:
    """id, x (array of floor(factor * component)), norm (sum of squares, double), the columns of more, and uid, which
    tells rows apart. Rows whose vector is not finite, or too long (LONGEST), are left out; an empty vector is the zero
    vector, and a shorter one counts as ending in zeros. uid changes from run to run: write the result."""
    vector = named(vector_col)
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(factor))))
    rows = df.filter(F.coalesce(finite(vector), F.lit(False))).select(named(id_col).cast("bigint").alias("id"), x.alias("x"), *more)
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.withColumn("norm", norm).filter(F.col("norm") < F.lit(LONGEST)).withColumn("uid", F.monotonically_increasing_id())


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of an array column as a matrix of longs, filled up with zeros to the longest, or to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.int64)
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    wide = max(width, int(sizes.max()))
    flat = column.values.to_numpy()[ends[0] : ends[-1]]
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with zeros up to the wider one's width."""
    wide = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == wide else np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of longs. No part of a sum is beyond the product of the
    lengths, so doubles are exact below 2^53, and longs are elsewhere."""
    a, b = widened(a, b)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    f, g = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt(np.einsum("ij,ij->i", f, f).max()) * np.sqrt(np.einsum("ij,ij->i", g, g).max()) < 1 << 52:
        return np.rint(f @ g.T).astype(np.int64)
    return a @ b.T


def ids_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers, zero where null, and whether they are null."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()
