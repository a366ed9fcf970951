"""Language identification and the quality classifier: held-out accuracy, parts, and edges."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, empty_documents, odd_documents
from pyspark.sql import functions as F

from strandmill.llm import language_id, quality

SF = "/root/testdata/sf0.01"


def test_grams_are_those_of_each_text():
    texts = ["Ab", "", "x", "日本語です"]
    together, counts = language_id.grams(texts)
    alone = [language_id.grams([t]) for t in texts]
    assert counts.sum() == len(together)
    at = 0
    for n in range(len(language_id.ORDERS)):
        for (own, c), t in zip(alone, texts, strict=True):
            start = c[:n].sum()
            assert together[at : at + c[n][0]].tolist() == own[start : start + c[n][0]].tolist(), (n, t)
            at += c[n][0]


def slow_bayes(rows, texts):
    """Multinomial naive Bayes by counting dictionaries."""
    counts, documents_of = {}, Counter()
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(language_id.grams([text])[0].tolist())
        documents_of[lang] += 1
    out = []
    for text in texts:
        own = Counter(language_id.grams([text])[0].tolist())
        logs = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS
            prior = (documents_of[lang] + 1) / (sum(documents_of.values()) + len(documents_of))
            logs[lang] = math.log(prior) + sum(n * math.log((c[b] + language_id.SMOOTHING) / whole) for b, n in own.items())
        out.append(logs)
    return out


def test_languages_against_plain_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 5 = 0")
    rows = [(r.lang, r.text) for r in docs.collect() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    some = docs.filter(F.length("text") < 3000).limit(60)
    got = some.select("text", language_id.predict(spark, model, F.col("text")).alias("p")).collect()
    for r, logs in zip(got, slow_bayes(rows, [r.text or "" for r in got]), strict=True):
        if any(c.isalpha() for c in r.text or ""):
            best = max(logs.values())
            assert logs[r.p.lang_pred] == pytest.approx(best, rel=1e-5)


def test_length_does_not_choose_the_language():
    """A prior and a likelihood that disagree: plain Bayes at every length, tempered only in the score."""
    log = np.log(np.full((2, language_id.BUCKETS), 1 / language_id.BUCKETS, np.float32))
    log[1] += 0.001
    model = language_id.Model(["a", "b"], np.log(np.array([0.7, 0.3])), log)
    for words in (10, 100, 2000):
        text = "word " * words
        n = language_id.grams([text])[1].sum()
        best, odds = model.choose([text])
        assert best[0] == int(0.001 * n + math.log(0.3) > math.log(0.7)) and 0 <= odds[0] <= 1


def test_languages_held_out(spark):
    rows = language_id.op6_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = odd_documents(spark)
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    rows = docs.select("text", language_id.predict(spark, model, F.col("text")).alias("p")).collect()
    for r in rows:
        assert (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language_id.train(empty_documents(spark))
    assert {r.p.lang_pred for r in docs.select(language_id.predict(spark, nothing, F.col("text")).alias("p")).collect()} == {"und"}
    bounded = language_id.train(docs, max_rows=8)
    assert set(bounded.languages) <= {"de", "en"}


def test_isotonic():
    total = np.array([10, 0, 10, 10, 0, 10.0])
    positive = np.array([1, 0, 6, 4, 0, 9.0])
    levels = quality.isotonic(total, positive)
    assert (np.diff(levels) >= 0).all() and levels[2] == levels[3] == pytest.approx(11 / 22) and levels[0] == pytest.approx(2 / 12)
    assert quality.isotonic(np.zeros(4), np.zeros(4)).tolist() == [0.5] * 4


def test_features_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 20_000)
    d = len(quality.STATISTICS)
    x = np.random.default_rng(1).standard_normal((6, d))
    z = quality.Model(np.zeros(d), np.ones(d)).features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * quality.WIDTH**2))).max() < 0.05


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in quality.op9_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95


def slow_scores(described, labels):
    """Ridge regression and pool-adjacent-violators on the driver, row by row."""
    known = {}
    for r in labels:
        if r.doc_id is not None and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            known.setdefault(r.doc_id, []).append(r.quality)
    rows = [(np.array(r.stats, float), y, r.fit) for r in described if r.doc_id in known for y in known[r.doc_id]]
    alone = np.array([r.stats for r in described if r.doc_id in known], float)
    model = quality.Model(alone.mean(axis=0), np.maximum(alone.std(axis=0), 1e-6))
    fit = [(x, y) for x, y, f in rows if f]
    x, y = model.features(np.array([x for x, _ in fit])), np.array([y for _, y in fit], float)
    model.weights = np.linalg.solve(x.T @ x + quality.PENALTY * np.eye(x.shape[1]) * len(y) / x.shape[1], x.T @ y)
    pools = []  # [bins, labels]
    bins = [(int(model.bins(x[None])[0]), y) for x, y, f in rows if not f]
    for b in sorted({b for b, _ in bins}):
        pools.append(([b], [y for k, y in bins if k == b]))
        while len(pools) > 1 and np.mean(pools[-2][1]) >= np.mean(pools[-1][1]):
            last = pools.pop()
            pools[-1] = (pools[-1][0] + last[0], pools[-1][1] + last[1])
    at = [b for p in pools for b in (p[0][0], p[0][-1])]
    level = np.maximum.accumulate([(sum(p[1]) + 1) / (len(p[1]) + 2) for p in pools for _ in range(2)])
    return {tuple(r.stats): float(np.interp(model.bins(np.array([r.stats], float))[0], at, level)) for r in described}


def test_scores_against_a_slow_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    described = quality.describe(docs).withColumn("fit", F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATION)) != 0)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = slow_scores(described.collect(), labels.collect())
    stats = {r.doc_id: tuple(r.stats) for r in described.collect()}
    got = quality.op9_quality(spark, SF).collect()
    assert len(got) == docs.count()
    apart = [r for r in got if abs(r.score - want[stats[r.doc_id]]) > 1e-9]
    assert len(apart) <= len(got) // 100  # a raw score at the border of a bin may fall on either side
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_quality_edges(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(15)] + [(1, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    described = quality.describe(docs)
    assert described.count() == docs.count()
    for own in (labels, labels.filter("false"), labels.filter("quality = 1"), labels.union(labels).union(labels)):
        model = quality.train(described, quality.known_labels(own))
        scores = [r.s for r in described.select(quality.score_column(spark, model, F.col("stats")).alias("s")).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.known_labels(labels, 5).count() < quality.known_labels(labels).count()
    kept = quality.keep_good(docs, labels.filter("false"))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.describe(empty_documents(spark)).count() == 0
    assert quality.keep_good(empty_documents(spark), labels).count() == 0
    assert not quality.statistics(b"").any() and np.isfinite(quality.statistics(b"x")).all() and np.isfinite(quality.statistics(b"\n \x00")).all()
    assert documents(spark).count() > 0
