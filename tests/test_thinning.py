"""Walks along diagonals, whole and in ranges, against the serial rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import thinning


def serial(rows, bars_all):
    """rows: (group, place, leap, takes) in order; takes says whether the row, if used, bars others."""
    group, end, out = None, None, []
    for g, place, leap, takes in rows:
        if g != group:
            group, end = g, None
        if end is not None and place < end:
            continue
        out.append((g, place))
        if takes or bars_all:
            end = place + leap
    return out


def random_rows(seed, groups=5, places=400):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        for p in sorted(r.sample(range(places), r.randrange(1, places))):
            rows.append((g, p, r.choice([1, 7, 40, 90]), r.random() < 0.3))
    return rows


@pytest.mark.parametrize("seed", range(30))
def test_walk_of_a_batch(seed):
    rows = random_rows(seed)
    group, place, leap, takes = (np.array(c) for c in zip(*rows, strict=True))
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    used = thinning.walked(place, np.where(takes, leap, 0), firsts, np.full(len(firsts), thinning.NOWHERE))
    assert [(rows[i][0], rows[i][1]) for i in np.flatnonzero(used)] == serial(rows, False)


@pytest.mark.parametrize("seed", range(30))
def test_functions_of_ranges_compose(seed):
    """Ranges entered where the ones before leave them are walked as the whole is."""
    rows = random_rows(seed, 1, 600)
    _, place, leap, takes = (np.array(c) for c in zip(*rows, strict=True))
    leap = np.where(takes, leap, 0)
    entry, out = thinning.NOWHERE, []
    for a in range(0, 600, 64):
        own = (place >= a) & (place < a + 64)
        if not own.any():
            continue
        used = thinning.walked(place[own], leap[own], np.array([0]), np.array([entry]))
        out += place[own][used].tolist()
        uppers, outs = thinning.range_function(place[own], leap[own], int(leap.max()))
        k = np.searchsorted(uppers, entry)
        entry = int(outs[k]) if k < len(uppers) and outs[k] != thinning.NOWHERE else entry
    assert out == [p for _, p in serial(rows, False)]


def test_functions_have_few_pieces():
    places = np.arange(100_000)
    uppers, outs = thinning.range_function(places, np.full(len(places), 64), 64)
    assert len(uppers) <= 66  # one for each possible entry
    long = np.where(places % 5_000 == 0, 4_000, 0)
    uppers, outs = thinning.range_function(places, long, 4_000)
    assert len(uppers) == 1  # whatever the entry, the walk leaves behind the same fragment


def seeds_of(spark, rows):
    data = [("f", g, p, p - g, 0, 0, length, takes) for g, p, length, takes in rows]
    return spark.createDataFrame(data, f"{thinning.HIT}, length bigint, accepted boolean").repartition(5)


@pytest.mark.parametrize("hot", [1 << 20, 50, 0])
def test_operators(spark, monkeypatch, hot):
    monkeypatch.setattr(thinning, "HOT", hot)
    monkeypatch.setattr(thinning, "SPAN", 37)
    rows = random_rows(1, 9)
    seeds = seeds_of(spark, rows)
    assert sorted((r.diag, r.posX) for r in thinning.skip_covered(seeds).collect()) == serial(rows, False)
    assert sorted((r.diag, r.posX) for r in thinning.thin(seeds, 8).collect()) == serial([(g, p, 16, True) for g, p, _, _ in rows], True)


def test_one_diagonal_over_several_tasks(spark, monkeypatch):
    """A sequence against itself: every place of diagonal zero is a hit."""
    monkeypatch.setattr(thinning, "HOT", 1_000)
    monkeypatch.setattr(thinning, "SPAN", 4_096)
    n = 100_000
    hits = spark.range(n).select(F.lit("f").alias("strand"), F.lit(0).cast("bigint").alias("diag"), F.col("id").alias("posX"), F.col("id").alias("posY"), *[F.lit(0).cast("bigint").alias(c) for c in ("seqX", "seqY")])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = thinning.thin(hits, 32).select("posX", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.posX for r in kept) == list(range(0, n, 64))
    assert len({r.task for r in kept}) >= 8
