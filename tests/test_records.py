"""Hits of short words, counted or extended record by record, against those that are made one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import genome

from strandmill.operators import extension, records, seeds
from strandmill.plans.compare import Comparison

FLIP = str.maketrans("ACGT", "TGCA")


def texts(seed):
    """Records with copies, changed a little, of each other's parts, unknown bases and a letter that repeats."""
    r = random.Random(seed)
    core = "".join(r.choice("ACGT") for _ in range(900))

    def changed(s, rate):
        return "".join(r.choice("ACGTN") if r.random() < rate else c for c in s)

    x = [changed(core[a : a + r.randint(20, 500)], 0.03) + "".join(r.choice("AC") for _ in range(r.randint(0, 90))) for a in range(0, 800, 60)]
    y = [changed(core, 0.05), "A" * 70 + core[300:420], changed(core[::-1].translate(FLIP)[100:600], 0.04), "", "ACGT"]
    return [*x, "A" * 150, "", core], y


def told(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize(("k", "fl"), [(16, 3)])
def test_counts(spark, monkeypatch, k, fl):
    a, b = texts(k + fl)
    x, y = genome(spark, *a), genome(spark, *b)
    slow = told(seeds.hits(x, y, k, fl).groupBy("strand", "seqX", "seqY").agg(F.count(F.lit(1)).alias("n")))
    monkeypatch.setattr(records, "AT_ONCE", 300)  # many parts, in each of which a word is rare
    monkeypatch.setattr(seeds, "join_words", None)  # no hit is made
    assert told(seeds.hit_counts(x, y, k, fl)) == slow and slow


@pytest.mark.parametrize(("fl", "hits", "strands"), [(6, 50, "fr")])
def test_fragments(spark, monkeypatch, fl, hits, strands):
    a, b = texts(fl)
    x, y = genome(spark, *a), genome(spark, *b)
    one_by_one = Comparison(x, y, k=16, lmin=30, fl=fl, strands=strands)
    assert one_by_one.used.count() > 0
    monkeypatch.setattr(records, "HITS", hits)
    c = Comparison(x, y, k=16, lmin=30, fl=fl, strands=strands)
    assert told(c.fragments) == told(one_by_one.fragments) and c.fragments.count() > 5
    assert "hits" not in c._kept and "thinned" not in c._kept


def test_much_of_y_is_joined(spark, monkeypatch):
    """Beyond the limits hits are made as of longer words."""
    a, b = texts(1)
    x, y = genome(spark, *a), genome(spark, *b)
    few = told(Comparison(x, y, k=16, lmin=30).fragments)
    monkeypatch.setattr(records, "BROADCAST_ROWS", 10)
    c = Comparison(x, y, k=16, lmin=30)
    assert told(c.fragments) == few and "hits" in c._kept


def test_steps_of_many_hits_at_once():
    r = np.random.default_rng(3)
    for letters in (b"ACGT", b"ACGTN", b"A"):
        x, y = (r.choice(np.frombuffer(letters, np.uint8), 3000) for _ in "xy")
        y[500:2500] = np.where(r.random(2000) < 0.7, x[500:2500], y[500:2500])
        px = py = np.concatenate([r.integers(0, 2999, 60), [0, 600, 2999]])
        n = np.minimum(3000 - px, r.integers(0, 3000, len(px)))
        best, steps, matches = records.went(x, y, px, py, n, np.full(len(px), 64))
        for i, (p, m) in enumerate(zip(px, n, strict=True)):
            state = extension.walk(x[p : p + m], y[p : p + m], (64, 64, 0, 0, 0, 0))[1]
            assert (best[i], steps[i], matches[i]) == state[1:4]
