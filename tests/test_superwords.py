"""Counts by super-words against counts of single words."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import S32, S40, genome

from strandmill.operators import dictionary, kmers, superwords


def random_dna(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_runs_cover_all_words_once(seed):
    r = random.Random(seed)
    dna = random_dna(r, 900, "ACGTACGTACGTACGTN" if seed % 2 else "ACGT") + "A" * 700 + random_dna(r, 50)
    codes = kmers.base_codes(np.frombuffer(dna.encode(), np.uint8), "skip")
    first, size, bucket = superwords.runs(codes, 64)
    assert size.max() <= superwords.RUN and len(first) < 0.4 * size.sum()
    starts, words = kmers.pack_words(np.frombuffer(dna.encode(), np.uint8), "skip")
    assert np.concatenate([np.arange(a, a + n) for a, n in zip(first, size, strict=True)]).tolist() == starts.tolist()
    told = superwords.unpacked(size.astype(np.uint8), superwords.packed(codes, first, size))
    assert told.tolist() == words.tolist()
    of = {}
    for w, b in zip(words.tolist(), np.repeat(bucket, size).tolist(), strict=True):
        assert of.setdefault(w, b) == b  # a word has one bucket
    assert len(superwords.packed(codes, first, size)) < 2 * len(dna)


@pytest.mark.parametrize(("share", "at_once", "slice_"), [(1 << 23, 1 << 21, 1 << 20), (50, 40, 97)])
def test_same_counts(spark, monkeypatch, share, at_once, slice_):
    for name, value in (("SHARE", share), ("AT_ONCE", at_once), ("SLICE", slice_)):
        monkeypatch.setattr(superwords, name, value)
    r = random.Random(4)
    core = random_dna(r, 400)
    g = genome(spark, core, core[100:300], "A" * 500, "", "ACGT", S32, S40 + "N" + S40, random_dna(r, 300))
    expected = {x.code: x.num for x in dictionary.dictionary(kmers.kmers(g)).collect()}
    rows = superwords.word_counts(g).collect()
    assert {x.code: x.num for x in rows} == expected and len(rows) == len(expected) and max(expected.values()) > 400
    assert sorted(map(tuple, dictionary.histogram(superwords.word_counts(g)).collect())) == sorted(Counter(n for n in expected.values() if n < 1001).items())


def test_no_words(spark):
    assert superwords.word_counts(genome(spark)).count() == superwords.word_counts(genome(spark, "ACGT")).count() == 0


def test_large_buckets_need_no_sum_of_their_shares(spark, monkeypatch):
    for name, value in (("SHARE", 50), ("BUCKET", 20), ("AT_ONCE", 40), ("IN_TASK", 1)):
        monkeypatch.setattr(superwords, name, value)
    r = random.Random(7)
    core = random_dna(r, 300)
    g = genome(spark, core, "A" * 900, "AC" * 300, core, core[50:200])
    counts = superwords.word_counts(g)
    assert "HashAggregate" not in counts._jdf.queryExecution().executedPlan().toString()  # all places of a word meet in one share
    assert {x.code: x.num for x in counts.collect()} == {x.code: x.num for x in dictionary.dictionary(kmers.kmers(g)).collect()}
    assert counts.count() == counts.select("code").distinct().count()


def test_words_of_large_buckets_travel_as_runs(spark, monkeypatch):
    """All words of a super-word's share, once, in few bytes a word; no table of them is written."""
    monkeypatch.setattr(superwords, "saved", lambda *_: pytest.fail("written"), raising=False)
    r = random.Random(9)
    core = random_dna(r, 3000)
    g = genome(spark, core, core[500:2500], "ACGTTGCA" * 100)
    hot = superwords.large_buckets(g, 4, 32, "skip", 0, 100)
    assert hot[0].tolist() == [0, 1, 2, 3] and (hot[1] > 4).all()
    rows, of, n = superwords.super_words(g, 4, "skip", hot).collect(), {}, 0
    for row in rows:
        lengths = np.frombuffer(superwords.unzipped(row.lengths, row.runs), np.uint8)
        bases = np.frombuffer(superwords.unzipped(row.bases, int((-(-(lengths.astype(int) + 31) // 4)).sum())), np.uint8)
        for w in superwords.unpacked(lengths, bases).tolist():
            assert of.setdefault(w, (row.bucket, row.share)) == (row.bucket, row.share)
        n += int(lengths.sum())
    codes = kmers.base_codes(np.frombuffer(core.encode(), np.uint8), "skip")
    first, size, bucket, share = superwords.shared_runs(codes, 4, hot)
    assert n == g.selectExpr("sum(len - 31)").first()[0] and len(set(of.values())) > 20
    assert len(superwords.packed(codes, first, size)) + len(first) < 3 * (len(codes) - 31)
    assert len(superwords.word_counts(g).collect()) == len(of)
