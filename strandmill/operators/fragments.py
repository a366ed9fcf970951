"""Accepted fragments, their statistics and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the coverage table; lengths of the threshold table.
LAST_LENGTH = 999
COLUMNS = ("diag", "xStart", "yStart", "xEnd", "yEnd", "length", "ident", "score", "similarity", "seqX", "seqY", "block", "strand")


def least_length(lmin: int, x: DataFrame | None = None, y: DataFrame | None = None) -> int:
    """lmin itself, or, given both genomes, lmin percent of the shorter of their first records."""
    if x is None or y is None:
        return lmin
    first = [s.filter("seq = 0").agg(F.max("len")).first()[0] or 0 for s in (x, y)]
    return int(min(first) * (lmin / 100.0))


def least_lengths(lmin: int, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """genome_x, genome_y, least: lmin percent of the shorter first record of each pair."""
    first = records.filter("seq = 0").select("genome", "len")
    x, y = (first.select(F.col("genome").alias(f"genome_{s}"), F.col("len").alias(f"first_{s}")) for s in "xy")
    both = pairs.join(x, "genome_x", "left").join(y, "genome_y", "left")
    shorter = F.least(F.coalesce("first_x", F.lit(0)), F.coalesce("first_y", F.lit(0)))
    return both.select("genome_x", "genome_y", (shorter * F.lit(lmin / 100.0)).cast("bigint").alias("least"))


def judged(extended: DataFrame, lmin: int | Column, simthr: float) -> DataFrame:
    """Adds accepted: longer than lmin and more similar than simthr, both strictly."""
    return extended.withColumn("accepted", (F.col("length") > lmin) & (F.col("similarity") > F.lit(float(simthr)).cast("float")))


def fragments(used: DataFrame, n_y: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The accepted ones among the used seeds, as fragment rows, with the columns of by; seqY of the reverse
    strand is counted from the forward strand's first record."""
    seq_y = F.when(F.col("strand") == "r", (F.lit(n_y) if isinstance(n_y, int) else n_y) - F.col("seqY") - 1).otherwise(F.col("seqY"))
    return used.filter("accepted").withColumn("seqY", seq_y).withColumn("block", F.lit(0).cast("bigint")).select(*by, *COLUMNS)


def coverage(used: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of extended seeds by the columns of by, by length (the last bin takes all longer ones) and whole percent of
    similarity, accepted or not, both strands together."""
    return used.groupBy(*by, F.least("length", F.lit(LAST_LENGTH)).cast("int").alias("len_bin"), F.floor("similarity").cast("int").alias("sim_bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage_matrix(cover: DataFrame) -> DataFrame:
    """The coverage as a row for each length and a column for each percent from 0 to 100."""
    return cover.groupBy("len_bin").pivot("sim_bin", list(range(101))).agg(F.sum("n")).na.fill(0)


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)


def export(rows: DataFrame, y_total: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The table as exported, with the columns of by: coordinates of the reverse strand counted from the forward start, ratios
    with two decimals."""
    total = F.lit(y_total) if isinstance(y_total, int) else y_total

    def flipped(c: str) -> Column:
        return F.when(F.col("strand") == "r", total - F.col(c) - 1).otherwise(F.col(c)).alias(c)

    return rows.select(*by, F.lit("Frag").alias("Type"), "xStart", flipped("yStart"), "xEnd", flipped("yEnd"), "strand", "block", "length", "score", "ident", two_places(F.col("score") / (F.col("length") * 4.0)).alias("similarity"), two_places(F.col("ident") / F.col("length").cast("double")).alias("pct_ident"), "seqX", "seqY")


def write_csv(exported: DataFrame, path: str) -> None:
    exported.withColumnsRenamed({"strand": "strand(f/r)", "pct_ident": "%ident", "seqX": "SeqX", "seqY": "SeqY"}).write.csv(path, header=True)


def banded(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds low, up and zone from a table (length, low, up) by length, longer ones by its last possible
    row: 2 above up, 1 above low, else 0; null without a row. The table has 1000 rows at most."""
    found = rows.withColumn("__l", F.least("length", F.lit(LAST_LENGTH))).join(F.broadcast(thresholds.select(F.col("length").alias("__l"), "low", "up")), "__l", "left")
    zone = F.when(F.col("up").isNull(), None).when(F.col("similarity") > F.col("up"), 2).when(F.col("similarity") > F.col("low"), 1).otherwise(0)
    return found.withColumn("zone", zone).drop("__l")
