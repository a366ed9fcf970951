"""The similarity join against all pairs by plain Python sets."""

import random
import re

import numpy as np
import pytest
from helpers import documents, empty_documents, odd_documents

from strandmill.llm import near_jaccard


def slow_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))) if words else frozenset()


def slow_groups(texts):
    sets = sorted({slow_set(t) for t in texts}, key=sorted)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return {s: find(i) for i, s in enumerate(sets)}


def near_copies(seed=3):
    r = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(30))
    texts = []
    for k in range(40):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 4, 5, 6, 20, 60, 200]))] + (line.split() if k % 3 == 0 else [])
        texts.append(" ".join(words))
        for _ in range(r.randrange(4)):  # chains of changed copies, at all similarities
            words = list(words)
            for _ in range(max(1, len(words) // r.choice([15, 40, 80]))):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("buckets", [4, 1 << 16])
def test_against_all_pairs(spark, monkeypatch, buckets):
    monkeypatch.setattr(near_jaccard, "BUCKETS", buckets)
    texts = near_copies()
    groups = slow_groups(texts)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(groups[slow_set(t)], i)
    assert len(least) < len({slow_set(t) for t in texts})
    kept = near_jaccard.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_edges(spark):
    docs = odd_documents(spark)
    kept = near_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(slow_groups([r.text for r in docs.collect()]).values()))
    assert near_jaccard.keep_one(empty_documents(spark)).count() == 0
    first, second = "first text about rivers and hills", "second story of ships at sea"
    kept = near_jaccard.keep_one(documents(spark, [first, first.upper(), second, second + " now"], [None, None, None, 1]))
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("1", second + " now"), ("None", first), ("None", second)]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, changed in ((50, 3), (200, 30), (3000, 900)):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 62, changed, dtype=np.uint64)]))
        apart = sum(((int(x) ^ int(y)) & ((1 << 64) - 1)).bit_count() for x, y in zip(near_jaccard.parities(a), near_jaccard.parities(b), strict=True))
        assert apart <= len(np.setxor1d(a, b)) and (changed > 100 or apart > changed)
    assert near_jaccard.parities(np.empty(0, np.uint64)).tolist() == [0] * 8
