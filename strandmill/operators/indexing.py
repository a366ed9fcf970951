"""Global places and prefix sums without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.storage import saved

#: Relative error of the bucket bounds; it decides balance only.
ERROR = 0.001


def below(value: Column, bounds: list[float], first: int) -> Column:
    """`first` and the number of the sorted bounds up to the value, by halving them: a row makes few comparisons, whatever
    the number of bounds."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value >= F.lit(float(bounds[half])), below(value, bounds[half + 1 :], first + half + 1)).otherwise(below(value, bounds[:half], first))


def with_places(df: DataFrame, key: str | list[str], size: str | None = None, index: str = "place", before: str = "before", spot: str | None = None) -> DataFrame:
    """Adds `index`, the row's place by key (one column or several) from 0, and, if size names a column,
    `before`, the sum of size over all earlier rows. Rows of equal keys stand by a hash of the whole row, so
    that their places don't change when they are worked out again.

    Rows are put into buckets by approximate quantiles of the numeric column spot (the first key if None;
    nulls come first), which must never fall where the keys rise. A value that fills several buckets is cut by the
    hash, if it is the only key. Each bucket is numbered in its own window, and the few bucket totals are summed up.
    """
    keys = [key] if isinstance(key, str) else key
    spot = spot or keys[0]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    quantiles = df.approxQuantile(spot, [i / n for i in range(1, n)], ERROR) if n > 1 else []
    bounds = sorted(set(quantiles))
    value = F.col(spot)
    inside = below(value, bounds, 0)
    # Shares of a cut value, one for each bucket that it alone would fill, come before larger values of its bucket.
    cuts = F.lit(1)
    if len(keys) == 1:
        for b in bounds:
            if (times := quantiles.count(b)) > 1:
                cuts = F.when(value == F.lit(b), F.lit(times)).otherwise(cuts)
        cuts = F.when(value.isNull(), F.lit(n)).otherwise(cuts)
    share = F.floor((F.col("__tie") / F.lit(float(1 << 64)) + 0.5) * cuts)
    bucket = F.when(value.isNull(), 0).otherwise(inside + 1) * (2 * n) + F.when(cuts > 1, F.least(share, cuts - 1)).otherwise(2 * n - 1)
    own = F.col(size).cast("bigint") if size else F.lit(0).cast("bigint")
    rows = df.withColumn("__tie", F.xxhash64(*df.columns)).withColumn("__bucket", bucket.cast("bigint")).withColumn("__size", own)
    order = Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in keys], "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__c"), F.sum("__size").alias("__t"))
    rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__sum", F.sum("__size").over(order))
    ahead = Window.partitionBy().orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    totals = totals.select("__bucket", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__ahead"))
    # Written, so that they aren't summed up again whenever the rows are read.
    out = rows.join(F.broadcast(saved(totals, "totals")), "__bucket").withColumn(index, F.col("__rows") + F.col("__n") - 1)  # a few rows for each shuffle partition
    if size:
        out = out.withColumn(before, F.col("__ahead") + F.col("__sum") - F.col("__size"))
    return out.drop("__bucket", "__size", "__n", "__sum", "__rows", "__ahead", "__tie")
