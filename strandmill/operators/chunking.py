"""Chunks of records and of diagonal-sorted hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.indexing import with_places

#: Places of a range in which the hits of a diagonal are numbered on their own.
SPAN = 1 << 20


def static_sizes(n: int, chunks: int) -> list[int]:
    size = -(-n // chunks) if chunks else 0
    return [min(size, n - a) for a in range(0, n, size)] if size else []


def guided_sizes(n: int, workers: int, least: int) -> list[int]:
    """Each chunk takes the workers' share of what is left, `least` at least; a shorter rest joins the
    first chunk."""
    sizes: list[int] = []
    while n > 0:
        take = max(n // workers, min(n, least))
        if take < least and sizes:
            sizes[0] += take
        else:
            sizes.append(take)
        n -= take
    return sizes


def chunk_of(place: Column, sizes: list[int]) -> Column:
    """The chunk that a place falls into; sizes are a few hundred at most."""
    starts, at = [], 0
    for s in sizes:
        starts.append(at)
        at += s
    return F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= place)).cast("bigint") - 1


def chunked(records: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """records with chunk, by the order of key; sizes must add up to their number."""
    return with_places(records, key).withColumn("chunk", chunk_of(F.col("place"), sizes)).drop("place")


def diagonals(hits: DataFrame) -> DataFrame:
    """diag and n, a row for each diagonal."""
    return hits.groupBy("diag").agg(F.count(F.lit(1)).alias("n"))


def each_diagonal(hits: DataFrame) -> DataFrame:
    """Ranges of hit numbers (start to end, both counted in) in diagonal order, one for each diagonal."""
    placed = with_places(diagonals(hits), "diag", "n", "chunk", "start")
    return placed.select("chunk", "diag", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def balanced_diagonals(hits: DataFrame, chunks: int) -> DataFrame:
    """About equally many hits a chunk, whole diagonals only: a diagonal goes to the chunk in which its
    first hit would fall by number."""
    total = hits.count()
    size = max(1, -(-total // chunks))
    ranges = each_diagonal(hits).withColumn("chunk", F.floor(F.col("start") / size))
    return ranges.groupBy("chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_diagonals"))


def diagonal_bounds(hits: DataFrame) -> DataFrame:
    """Smallest and largest diagonal, zero always lying between."""
    return hits.agg(F.least(F.lit(0), F.min("diag")).alias("min_diag"), F.greatest(F.lit(0), F.max("diag")).alias("max_diag"))


def ranged_diagonals(hits: DataFrame, chunks: int) -> DataFrame:
    """Chunks by diagonal: with half a width h = (largest - smallest) / (chunks - 1) / 2 in whole numbers, the
    first chunk goes up to smallest + h, the next ones to + 3h, + 5h and so on, ends included, and the last
    one takes all that is left. Chunks without hits are left out."""
    low, high = (v or 0 for v in diagonal_bounds(hits).first())
    half = (high - low) // (2 * (chunks - 1)) if chunks > 1 else 0
    behind = F.ceil((F.col("diag") - F.lit(low + half)) / F.lit(2 * half)) if half else F.when(F.col("diag") > low, chunks - 1).otherwise(0)
    ranges = each_diagonal(hits).withColumn("chunk", F.greatest(F.lit(0), F.least(F.lit(chunks - 1), behind)).cast("bigint"))
    return ranges.groupBy("chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("diag").alias("first_diag"), F.max("diag").alias("last_diag"))


def numbered(hits: DataFrame, span: int = SPAN) -> DataFrame:
    """Each hit with its place along its diagonal, by posX. Hits are numbered in ranges of `span` places, whose totals are added up,
    so that a long diagonal is not one group. hits are read twice: pass a written table."""
    rows = hits.withColumn("__range", F.floor(F.col("posX") / span))
    totals = rows.groupBy("strand", "diag", "__range").agg(F.count(F.lit(1)).alias("__c"))
    ahead = Window.partitionBy("strand", "diag").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("strand", "diag", "__range", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"))
    order = Window.partitionBy("strand", "diag", "__range").orderBy("posX")
    placed = rows.withColumn("place", F.row_number().over(order).cast("bigint")).join(totals, ["strand", "diag", "__range"])
    return placed.select(*hits.columns, (F.col("place") + F.col("__before")).alias("place"))
