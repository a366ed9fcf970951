"""Whitening of embeddings by MLlib's singular values of the centred rows.

Entries become whole numbers, so the sums, and each row's squared deviation, are exact; the total variance comes from
these deviations alone. The centred rows are a distributed row matrix whose singular values s give the variances of
its components, e = s^2 / n, and its right singular vectors the components. Rows are projected in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, named, table
from strandmill.llm.vectors import finite, matrix

#: Components returned at most.
COMPONENTS = 8
#: Up to so many dimensions all singular values are asked for: MLlib then decomposes the Gram matrix directly, to double
#: precision. Beyond, it iterates for the first ones, to a tolerance of 1e-10.
DIRECT = 1_000
#: Singular values up to this share of the greatest count as zero.
RANK = 1e-9
#: Entries at or beyond this size leave no room for exact sums; their rows take no part.
LARGEST = float(1 << 40)


def whole_rows(df: DataFrame, id_col: str, vector_col: str, factor: int, shift: int) -> DataFrame:
    """id and x, array of floor(factor * entry) + shift, of the rows whose vector is finite."""
    vector = named(vector_col)
    usable = F.coalesce(finite(vector) & F.forall(vector, lambda c: F.abs(c.cast("double")) < F.lit(LARGEST)), F.lit(False))
    return df.filter(usable).select(named(id_col).alias("id"), F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(factor))) + F.lit(shift)).alias("x"))


def long_array(values: list[int]):
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def projected(rows: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """rows with w, the array of (x - mean) times each column of axes."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, deviation bigint, w array<double>"
    width = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(mean))
            w = (x - mean) @ axes
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.record_batch({"id": batch.column("id"), "deviation": batch.column("deviation"), "w": pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))})

    return rows.select("id", "deviation", "x").mapInArrow(run, schema)


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024, shift: int = 100_000, components: int = COMPONENTS) -> DataFrame:
    """id_col, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error for each row and component.

    Rows with a null vector, a null or non-finite entry, or one beyond LARGEST take no part; all others make the fit, repeated
    ones each. Null identifiers stay null. Shorter vectors count as ending in entries of zero. deviation is the exact sum
    of (n x - S)^2, null where it is beyond a long. Components without variance are left out, so equal rows, a single one, or none
    give no result. Signs are any, the same for all rows.
    """
    rows = materialize(whole_rows(df, id_col, vector_col, factor, shift), "whole-vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    empty = df.sparkSession.createDataFrame([], f"`{id_col.replace('`', '``')}` {df.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    if not n or not dims:
        return empty
    full = F.when(F.size("x") < dims, F.concat("x", F.array_repeat(F.lit(shift).cast("bigint"), F.lit(dims) - F.size("x")))).otherwise(F.col("x"))
    rows = rows.withColumn("x", full)
    sums = [0] * dims
    for r in rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).collect():  # a row for each dimension
        sums[r.pos] = r.s
    mean = np.array([s / n for s in sums])
    off = F.zip_with("x", long_array(sums), lambda x, s: x * F.lit(n) - s)
    exact = F.aggregate(off, F.lit(0).cast("bigint"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    # the same sum in decimals, for rows whose deviation is beyond a long
    wide = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    rows = materialize(rows.withColumn("deviation", exact), "deviations")
    total = rows.agg(F.sum(F.coalesce(F.col("deviation").cast("decimal(38,0)"), wide))).first()[0]
    trace = float(total) / float(n) ** 3
    if not trace:
        return empty

    centred = rows.select(array_to_vector(F.zip_with(F.transform("x", lambda x: x.cast("double")), F.array(*[F.lit(m) for m in mean.tolist()]), lambda x, m: x - m)).alias("v"))
    wanted = dims if dims <= DIRECT else min(components, dims)
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, dims).computeSVD(wanted, computeU=False, rCond=RANK)
    variances = np.square(svd.s.toArray())[:components] / n
    axes = svd.V.toArray()[:, : len(variances)]
    w = materialize(projected(rows, mean, axes / np.sqrt(variances)), "whitened")
    m = len(variances)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    moments = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(moments, pairs, strict=True))
    explained = F.array(*[F.lit(float(e) / trace) for e in variances])
    told = w.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return told.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened of embeddings; edge cases are those of whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
