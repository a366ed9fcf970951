"""Secret scans against a full scan, trigram queries against the regexes."""

import hashlib
import random
import re
import time

import pytest
from helpers import TEXTS, documents, empty_documents, odd_documents
from pyspark.sql import functions as F

from strandmill.llm import secrets

SF = "/root/testdata/sf0.01"
KINDS = [
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def slow(text):
    return sorted((m.start(), k, m.end()) for k, (_, x, g, n) in enumerate(KINDS) for m in x.finditer(text or "") if len(m.group(g)) >= n)


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({b"aki", b"kia"})]]
    (clause,) = secrets.trigram_query("(abc|de_?fg)[0-9]+")
    assert set(clause) == {frozenset({b"abc"}), frozenset({b"def", b"efg"}), frozenset({b"de_", b"e_f", b"_fg"})}
    (clause,) = secrets.trigram_query("x*abcd?")
    assert set(clause) == {frozenset({b"abc"}), frozenset({b"abc", b"bcd"})}
    (clause,) = secrets.trigram_query("(abc)?def")
    assert set(clause) == {frozenset({b"def"}), frozenset({b"abc", b"bcd", b"cde", b"def"})}
    assert secrets.trigram_query("(abc)*") == []


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_queries_never_lose_a_match(rule):
    r = random.Random(rule.kind)
    bits = ["password", "PassWd", "secret", "ToKeN", "apikey", "API_key", "=", ":", " ", '"', "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeefdeadbeef", "x", "é", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890ab", "eyJab.eyJcd.ef", "https://u:pass@", "ſecret", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(400)]
    query = secrets.trigram_query(rule.pattern)
    index = secrets.BlockIndex(frozenset(t for clause in query for s in clause for t in s))
    index.build([t.encode() for t in texts])
    found = set(index.find(query).tolist())
    assert {i for i, t in enumerate(texts) if rule.compiled.search(t)} <= found
    if query:
        assert len(found) < len(texts)


@pytest.mark.parametrize("pattern", ["ÉCOLE=[0-9]+", "(?i)kiss=[0-9]+", "(?i)éCole=[0-9]", "a(?i:skip)b[0-9]", "(?ai)kiss=[0-9]+", "(?i:x(?-i:sky)z)[0-9]+", "abc(?=[0-9])[0-9]x"])
def test_other_letters_and_flags(pattern):
    texts = ["zz ÉCOLE=12", "école=1", "ÉcOlE=1", "KISS=1", "\u212aiſſ=1", "kİss=1", "aſKIPb1", "aSkipb1", "XskyZ1", "XSKYZ1", "abc1x", "none"]
    rule = secrets.Rule("own", pattern)
    query = secrets.trigram_query(pattern)
    index = secrets.BlockIndex(frozenset(t for clause in query for s in clause for t in s))
    index.build([t.encode() for t in texts])
    found = set(index.find(query).tolist())
    assert {i for i, t in enumerate(texts) if rule.compiled.search(t)} <= found


def test_tokens_as_plain_patterns_find_them():
    plain = {"jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "url_password": r"[a-z]+://[A-Za-z0-9._-]+:[^\s:@/]{3,}@"}
    r = random.Random(9)
    bits = ["eyJ", "eyJa", ".", "x", "_", " ", "-", "eyJa.eyJb.c", "http", "://", "u", ":", "pass", "@", "/", "É", "https://a:bcd@"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        for rule in secrets.MORE:
            if rule.kind in plain:
                assert [(a, b) for _, a, b in rule.spans(text)] == [m.span() for m in re.finditer(plain[rule.kind], text)], text


def test_time_is_linear():
    for text in ("a" * 2_000_000, "eyJ" * 700_000, "eyJa.eyJb" * 200_000, "password" + " " * 2_000_000, "://" * 600_000, "-----BEGIN " + "A" * 2_000_000, "ghp_" * 500_000):
        began = time.perf_counter()
        for rule in secrets.RULES:
            list(rule.spans(text))
        assert time.perf_counter() - began < 10


def test_base_spans(spark):
    for r in secrets.find_secrets(odd_documents(spark)).collect():
        base = [(s.start, [k[0] for k in KINDS].index(s.kind), s.end) for s in r.secrets if s.kind in {k[0] for k in KINDS}]
        assert sorted(base) == slow(r.text)
    assert secrets.find_secrets(empty_documents(spark)).count() == 0


def test_assignments(spark):
    texts = ["token: 'abc' password=longenough", "TOKEN=\"é", "ſecret=abcdefgh", "éé secret = a.b/c+d==", "passwd:::abcdefg", "api_key=abcdef\napikey = 'abcdefg'", "token=token=abcdef"]
    for r in secrets.find_secrets(documents(spark, texts)).collect():
        assert [(s.start, s.end) for s in r.secrets if s.kind == "assign"] == [(a, b) for a, k, b in slow(r.text) if k == 0]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = secrets.op10_secrets(spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_hex for r in rows) > 0
    for r in rows:
        spans = slow(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_joined_spans_are_ordered(spark):
    spans = spark.createDataFrame([([("b", 5, 9), ("a", 5, 7), ("c", 1, 2)],)], "s array<struct<kind: string, start: bigint, end: bigint>>")
    assert spans.select(secrets.joined(F.col("s"), {"b": 0, "a": 1, "c": 2})).first()[0] == "c:1:2,b:5:9,a:5:7"
    assert len(TEXTS) > 0
