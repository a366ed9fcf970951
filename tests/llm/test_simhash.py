"""SimHash against a slow version, and components against union-find."""

import random
import re

import pytest
import xxhash
from helpers import documents, empty_documents, odd_documents
from oracle import SF
from pyspark.sql import functions as F

from strandmill.llm import simhash


def slow_print(text, n=3):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, radius):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in prints}


def expected(docs, words=3, radius=2):
    prints = [(r.doc_id, slow_print(r.text, words)) for r in docs.collect()]
    roots = slow_components({p for _, p in prints}, radius)
    least, size = {}, {}
    for i, p in prints:
        k = roots[p]
        size[k] = size.get(k, 0) + 1
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    return sorted((str(i), f"{p:016x}", str(least[roots[p]]), size[roots[p]]) for i, p in prints)


def found(rows):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id), r.component_size) for r in rows)


@pytest.mark.parametrize("words", [1, 3, 5])
def test_edges(spark, words):
    docs = odd_documents(spark)
    assert found(simhash.near_duplicates(docs, words=words).collect()) == expected(docs, words)
    assert simhash.near_duplicates(empty_documents(spark), words=words).count() == 0


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == slow_print(text)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = simhash.op3_simhash(spark, SF).collect()
    assert found(rows) == expected(docs)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_links_span_all_components(spark, radius):
    r = random.Random(2)
    prints = {r.getrandbits(64) for _ in range(60)}
    for _ in range(200):  # chains of near ones
        p = r.choice(sorted(prints))
        for _ in range(r.randrange(1, 4)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(p,) for p in signed.values()], "fp bigint")
    placed = {r.node: r.root for r in simhash.components(simhash.ball_links(frame, radius)).collect()}
    groups, want = {}, {}
    for p, root in slow_components(prints, radius).items():
        want.setdefault(root, set()).add(p)
        groups.setdefault(placed.get(signed[p], signed[p]), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, groups.values()))


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.ball_links(spark.createDataFrame([(1,)], "fp bigint"), 3)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (300, 301)]
    placed = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {placed[i] for i in range(61)} == {0} and {placed[i] for i in range(100, 160)} == {100} and placed[301] == 300
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
    same = documents(spark, ["a b c d e f"] * 40)
    assert [r.doc_id for r in simhash.keep_one(same).select(F.col("doc_id")).collect()] == [0]


def test_keep_one_keeps_one_for_each_component(spark):
    first, second, third, fourth = ("first text about rivers and hills", "second story of ships at sea", "third note on bread and salt", "fourth tale of snow")
    docs = documents(spark, [first, first.upper(), second, third, fourth, third.upper()], [None, None, None, 1, 1, None])
    kept = sorted((str(r.doc_id), r.text.lower()) for r in simhash.keep_one(docs).collect())
    assert kept == [("1", fourth), ("1", third), ("None", first), ("None", second)]
