"""Bloom filters of keys, and hits through them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import genome

from strandmill.operators import chunking, keyfilter, kmers, seeds
from strandmill.functions.dna import code_prefix


def test_filter_keeps_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    rows = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "key bigint").repartition(7)
    made = keyfilter.key_filter(rows, len(keys)).value
    assert keyfilter.passes(made, keys).all()
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 200_000, dtype=np.int64)
    assert keyfilter.passes(made, others).mean() < 0.005
    assert not keyfilter.passes(keyfilter.key_filter(rows.filter("false"), 0).value, others).any()


@pytest.mark.parametrize("k", [32, 16])
def test_same_hits_and_few_rows(spark, monkeypatch, k):
    r = random.Random(5)
    x = ["".join(r.choice("ACGT") for _ in range(3000)) for _ in range(3)]
    y = ["".join(r.choice("ACGT") for _ in range(2000)), x[1][500:900]]
    gx, gy = genome(spark, *x), genome(spark, *y)
    whole = sorted(map(tuple, seeds.hits(gx, gy, k).collect()))
    monkeypatch.setattr(seeds, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, seeds.hits(gx, gy, k).collect())) == whole and whole
    keys = kmers.kmers(gy).select(code_prefix(F.col("code"), k).alias("key")).distinct()
    made = kmers.kmers(gx, keys=(keyfilter.key_filter(keys, keys.count()), k))
    wanted = kmers.kmers(gx).withColumn("key", code_prefix(F.col("code"), k)).join(keys, "key", "left_semi").count()
    assert wanted <= made.count() <= wanted * 1.05 + 1


@pytest.mark.parametrize("span", [1 << 20, 7])
def test_numbers_along_diagonals(spark, span):
    r = random.Random(2)
    rows = [(s, d, p) for s in "fr" for d in range(4) for p in r.sample(range(60), r.randrange(1, 40))]
    found = chunking.numbered(spark.createDataFrame(rows, "strand string, diag bigint, posX bigint"), span).collect()
    assert sorted(map(tuple, found)) == sorted((s, d, p, sum(q <= p for t, e, q in rows if (t, e) == (s, d))) for s, d, p in rows)


def test_few_keys_filter_words_where_they_are_made(spark, monkeypatch):
    """Also if the keys are few enough to be broadcast, words of X that can't meet any are no rows."""
    r, made = random.Random(8), []
    x, y = ["".join(r.choice("ACGT") for _ in range(4000))], []
    y = [x[0][100:200]]

    def watched(*args, **more):
        out = kmers.kmers(*args, **more)
        if more.get("keys"):
            made.append(out.count())
        return out

    monkeypatch.setattr(seeds, "kmers", watched)
    assert seeds.hits(genome(spark, *x), genome(spark, *y)).count() == 69
    assert len(made) == 1 and 69 <= made[0] < 100


def test_words_of_many_records_are_handed_over_together(spark, monkeypatch):
    monkeypatch.setattr(kmers, "ROWS", 50)
    r = random.Random(9)
    g = genome(spark, *["".join(r.choice("ACGT") for _ in range(n)) for n in (40, 0, 33, 200, 31, 64)])
    rows = [tuple(x) for x in kmers.kmers(g).collect()]
    assert len(rows) == len(set(rows)) == 9 + 2 + 169 + 33
    assert kmers.kmers(g.withColumn("name", F.concat(F.lit("g"), "seq")), label="name").filter("name = concat('g', seq)").count() == len(rows)


@pytest.mark.parametrize(("k", "looked"), [(32, True), (31, True), (30, False)])
def test_words_by_anchors(spark, k, looked):
    """A key's words are found wherever they lie, though most places are not looked at."""
    r = random.Random(k)
    records = ["".join(r.choice("ACGT" * 20 + "N") for _ in range(n)) for n in (0, 31, 32, 33, 70, 3000, 41)]
    core = "".join(r.choice("ACGT") for _ in range(60))
    records[5] = "".join(records[5][i * 100 : i * 100 + 100] + core[i % 9 : 40 + i] for i in range(17))
    own = genome(spark, *records)
    every = kmers.kmers(own)
    keys = kmers.kmers(genome(spark, core)).select(code_prefix(F.col("code"), k).alias("key")).distinct()
    anchors = keyfilter.anchor_filter(keys, keys.count(), k)
    assert (anchors is not None) == looked
    met = kmers.kmers(own, keys=(keyfilter.key_filter(keys, keys.count()), k), anchors=anchors)
    wanted = {tuple(w) for w in every.withColumn("key", code_prefix(F.col("code"), k)).join(keys, "key", "left_semi").select("code", "seq", "pos").collect()}
    got = {tuple(w) for w in met.collect()}
    assert wanted and wanted <= got and len(got) < every.count() / 2
    if looked:
        assert len(kmers.anchored_words(np.frombuffer(records[5].encode(), np.uint8), "skip", anchors.value)[0]) < len(records[5]) / 2
