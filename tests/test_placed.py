"""Words with places by runs: the same hits as of single words, in far fewer rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_collections import PAIRS, collection, genome_of, records, wanted
from test_operators import genome

from strandmill.operators import kmers, pairs, placed, seeds, thinning
from strandmill.sources import blocks
from strandmill.storage import saved


def grouped(g, group=0):
    return g.withColumn("group", F.lit(group).cast("bigint"))


@pytest.mark.parametrize(("slice_", "k"), [(1 << 20, 32), (97, 32), (97, 16), (1 << 20, 9)])
def test_runs_hold_all_words(spark, monkeypatch, slice_, k):
    monkeypatch.setattr(placed, "SLICE", slice_)
    r = random.Random(3)
    g = genome(spark, *["".join(r.choice("ACGT" * 9 + "N") for _ in range(n)) for n in (700, 0, 31, 32, 500)], "A" * 900)
    rows = placed.placed_runs(grouped(g, 7), 8, k).collect()
    found, buckets = [], {}
    for row in rows:
        code, group, seq, place = placed.words_in(row.asDict())
        assert len(code) == row.n and set(group.tolist()) == {7}
        found += zip(code.view(np.int64).tolist(), seq.tolist(), place.tolist(), strict=True)
        for key in (code >> np.uint64(64 - 2 * k)).tolist():
            assert buckets.setdefault(key, row.bucket) == row.bucket
    assert sorted(found) == sorted(map(tuple, kmers.kmers(g).collect()))


def test_coded_numbers():
    for values in ([5], [5, 4, 9], [1 << 40, 0, 3], [-(1 << 62), (1 << 62) - 1], list(range(100, 400))):
        assert placed.decoded(placed.coded(np.array(values)), len(values)).tolist() == values


@pytest.mark.parametrize("fl", [1000, 2])
@pytest.mark.parametrize("k", [32, 16])
def test_hits_in_shares_and_parts(spark, monkeypatch, fl, k):
    for of, name, value in ((placed, "SHARE", 300), (placed, "BUCKET", 100), (placed.Frequent, "AT_ONCE", 50), (placed.Pairing, "PAIRS", 3), (placed.Pairing, "HITS", 7), (placed, "SLICE", 150)):
        monkeypatch.setattr(of, name, value)
    x = collection(spark, records(copies=3))
    got = {}
    for h in seeds.collection_hits(x, wanted(spark, *PAIRS), k, fl).collect():
        got.setdefault(h.genome_x + h.genome_y, []).append(tuple(h)[2:])
    for a, b in PAIRS:
        assert sorted(got.get(a + b, [])) == sorted(map(tuple, seeds.hits(genome_of(x, a), genome_of(x, b), k, fl).collect())), (a, b)
    assert fl == 2 or got["ab"]


def test_a_word_that_is_everywhere_is_one_row():
    own = placed.Frequent(5)
    own.AT_ONCE = 10
    for i in range(1000):
        own.add((np.array([1, i + 2], np.uint64), np.zeros(2, np.int64), np.zeros(2, np.int64), np.array([i, i])))
    assert sum(len(w[0]) for w in own.waiting) < 1020
    assert 1 not in own.counted(own.taken())[0][own.counted(own.taken())[4] <= 5]


def test_words_of_many_genomes_travel_as_runs(spark):
    """What is dealt out is a row for each bucket and task, not one for each word."""
    r = random.Random(1)
    x = collection(spark, [(g, i, f"r{i}", "".join(r.choice("ACGT") for _ in range(2000))) for i, g in enumerate("abc" * 4)])
    seeds.collection_hits(x, wanted(spark, "ab", "ac")).collect()
    rows = placed.placed_runs(grouped(x), 16)
    told = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(sum(F.octet_length(c) for c in ("lengths", "bases", *placed.NUMBERS)))).first()
    assert told[0] <= 16 * rows.rdd.getNumPartitions() and told[1] == 12 * 1969 and told[2] < 3 * told[1]


@pytest.mark.parametrize(("share", "giant"), [(1 << 23, 1 << 23), (60, 1 << 20), (60, 100)])
def test_strided_words(spark, monkeypatch, share, giant):
    for name, value in (("SHARE", share), ("BUCKET", 20), ("GIANT", giant)):
        monkeypatch.setattr(placed, name, value)
    r = random.Random(11)
    core = "".join(r.choice("ACGT") for _ in range(60))
    g = genome(spark, *[core[: r.randrange(32, 61)] + r.choice("ACGT") for _ in range(45)], "A" * 300, "C" * 80)
    places = {}
    for w in sorted(map(tuple, kmers.kmers(g).collect())):
        places.setdefault(w[0], []).append(w[1:])
    expected = [(c, *p, len(ps)) for c, ps in places.items() if len(ps) >= 20 for i, p in enumerate(ps) if i % max(1, len(ps) // 10) == 0]
    assert sorted(map(tuple, placed.strided_words(g, 20, 10).collect())) == sorted(expected) and max(e[3] for e in expected) > 200


@pytest.mark.parametrize("fl", [1000, 2])
def test_shared_words_by_buckets(spark, monkeypatch, fl):
    for of, name, value in ((placed, "SHARE", 300), (placed, "BUCKET", 100), (placed.Frequent, "AT_ONCE", 50), (placed.Shared, "PAIRS", 3)):
        monkeypatch.setattr(of, name, value)
    x = collection(spark, records(copies=3))
    plain = pairs.shared_word_counts(kmers.kmers(x, label="genome", columns=("code",)), fl)
    expected = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, pairs.shared_words(x, fl).collect())) == expected and expected
    assert sorted(map(tuple, pairs.shared_words(x, fl, most=2).collect())) == expected


def test_sequences_do_not_travel_to_few_genomes_or_heads(spark):
    """Joins with a row for each genome, or with the heads of few blocks, are broadcast, whatever Spark guesses of sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = collection(spark, records())
        tails = blocks._with_tails(spark.createDataFrame([(0, 0, "A" * 40), (0, 1, "CG"), (1, 0, "T")], "seq bigint, block bigint, bases string"), [], 40)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (x, tails)]
        assert sorted(r.tail for r in tails.collect()) == ["", "", "CG"] and x.count() == len(records())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize(("hits", "hot", "span"), [(1 << 19, 1 << 20, 1 << 18), (50, 1 << 20, 7), (1 << 19, 20, 16)])
def test_hits_travel_in_runs(spark, monkeypatch, hits, hot, span):
    """A passage that two genomes share is a few rows, not one for each of its words; what they are thinned to is the same."""
    for of, name, value in ((placed.Pairing, "HITS", hits), (thinning, "HOT", hot), (thinning, "SPAN", span)):
        monkeypatch.setattr(of, name, value)
    r = random.Random(5)
    core = "".join(r.choice("ACGT") for _ in range(900))
    x = collection(spark, [(g, i, f"r{i}", ("AC" * 40 + core)[:: 1 if i % 2 else -1] + "".join(r.choice("ACGT") for _ in range(80))) for i, g in enumerate("abc" * 2)])
    pairs_ = wanted(spark, "ab", "ac", "bc")
    runs = saved(seeds.collection_hits(x, pairs_, runs=True), "runs")
    single = saved(seeds.collection_hits(x, pairs_), "hits")
    expected = sorted(map(tuple, single.collect()))
    assert sorted(map(tuple, thinning.single_hits(runs).collect())) == expected and len(expected) > 5000
    assert hits == 50 or runs.count() < len(expected) / 4
    by = ("genome_x", "genome_y")
    assert sorted(map(tuple, thinning.thin_runs(runs, 32, by).collect())) == sorted(map(tuple, thinning.thin(single, 32, by).collect()))


def test_shared_words_are_not_written(spark, monkeypatch):
    """Words and their genomes go through one shuffle, without places, also those of large buckets."""
    x = collection(spark, records(copies=3))
    expected = sorted(map(tuple, pairs.shared_words(x, 1000).collect()))
    for of, name, value in ((placed, "SHARE", 60), (placed, "BUCKET", 20)):
        monkeypatch.setattr(of, name, value)
    for of in (placed, pairs):
        monkeypatch.setattr(of, "saved", lambda *_: pytest.fail("written"))
    assert sorted(map(tuple, pairs.shared_words(x, 1000).collect())) == expected and expected
