"""Mixing, exact deduplication and the WARC audit against SQL and plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from helpers import TEXTS, documents, empty_documents, odd_documents
from oracle import SF, connect, same
from pyspark.sql import functions as F

from strandmill.llm import exact_dedup, mixing, warc_audit


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("module", [mixing, exact_dedup, warc_audit])
def test_against_sql(spark, con, module):
    for name, sql in module.ORACLES.items():
        same(module.QUERIES[name](spark, SF), sql, con)


def test_exact_dedup_edges(spark):
    docs = odd_documents(spark)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        own = by_digest[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == min((i for i in own if i is not None), default=None)
    for digest in by_digest:
        assert sum(r.kept for r in rows if r.text_sha256 == digest) == 1
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty_documents(spark)).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    docs = documents(spark, ["same  text"] * 250 + ["same text"] * 250 + [f"other {i % 60}" for i in range(120)], list(range(619, -1, -1)))
    for n in (1, 7):
        hot = exact_dedup.hot_texts(docs, "text", n).collect()
        assert (not hot) if n == 1 else [h.hot_beginning for h in hot] == ["same text"] and 5 <= hot[0].pieces <= 7
        rows = exact_dedup.exact_dedup(docs, n=n).collect()
        assert sorted((r.keep_id, r.group_size, r.kept) for r in rows).count((120, 500, True)) == 1
        assert sum(r.kept for r in rows) == 61 and {r.group_size for r in rows} == {500, 2}
        assert sorted(r.doc_id for r in exact_dedup.keep_first(docs, n=n).collect()) == sorted(r.doc_id for r in rows if r.kept)


@pytest.mark.parametrize("n", [1, 5, 50])
def test_the_sort_itself_finds_equal_texts(spark, n):
    """Only texts that fill whole partitions come in more than one run."""
    texts = [f"a long common beginning that many texts share, then number {i % 200}" for i in range(400)] + ["hot"] * 100
    docs = documents(spark, texts)
    runs = exact_dedup.content_sorted(docs, "doc_id", "text", n).filter("place = 1").collect()
    assert 201 <= len(runs) <= 201 + n and len({r.digest for r in runs}) == 201
    assert all(r.hot for r in runs if sum(x.digest == r.digest for x in runs) > 1)


def test_hot_texts_are_found_in_a_sample(spark):
    docs = documents(spark, ["hot"] * 3000 + [f"other {i}" for i in range(3000)])
    found = exact_dedup.hot_texts(docs, "text", 4, sampled=50).collect()
    assert [h.hot_beginning for h in found] == ["hot"] and found[0].pieces in (2, 3)


def test_mixing_reaches_its_targets(spark):
    docs = documents(spark, [f"word {'1 ' if i % 4 == 0 else ''}" + "x " * (i % 9) for i in range(900)])
    targets = {"source": 0.5, "lang": {"en": 0.7, "de": 0.3}, "topic": {"prose": 0.6, "numeric": 0.4}}
    mixed = mixing.mix(docs, targets=targets, sweeps=30).select("mixing.*")
    share = {r.topic: r.w for r in mixed.groupBy("topic").agg(F.sum(F.col("weight") * F.col("tokens")).alias("w")).collect()}
    assert share["prose"] / sum(share.values()) == pytest.approx(0.6, abs=1e-6)
    one = mixed.agg(F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens")).first()[0]
    assert one == pytest.approx(mixing.BUDGET, abs=1e-6)
    taken = mixed.filter("sampled").count()
    assert 0.5 * 900 < taken < 0.9 * 900


def test_mixing_edges(spark, monkeypatch):
    docs = odd_documents(spark)
    plain = sorted(map(str, mixing.mix(docs).select("doc_id", "mixing").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    mixed = mixing.mix(docs)
    assert mixed.count() == docs.count() and mixed.columns == [c for c in docs.columns if c != "mixing"] + ["mixing"]
    assert sorted(map(str, mixed.select("doc_id", "mixing").collect())) == plain
    assert all(0 <= r.mixing.probability <= 1 and r.mixing.tokens >= 1 for r in mixed.collect())
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_mixing_with_targets_of_zero(spark):
    docs = documents(spark, [f"word {'1 ' if i % 4 == 0 else ''}" + "x " * (i % 9) for i in range(300)])
    mixed = mixing.mix(docs, targets={"source": {"src0": 0.0}, "lang": {"en": 0, "de": 1, mixing.UNKNOWN: 0}, "topic": 1.0}).select("mixing.*").collect()
    assert all(r.probability == 0 and not r.sampled for r in mixed if r.source == "src0" or r.lang != "de")
    assert any(r.sampled for r in mixed)
    none = mixing.mix(docs, targets={"topic": {"prose": 0, "numeric": 0}}).select("mixing.*").collect()
    assert {r.weight for r in none} == {1.0}


def test_mixing_by_a_column_of_topics(spark):
    docs = documents(spark, ["a b c"] * 40).withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "x"))
    mixed = mixing.mix(docs, topic_col="kind", targets={"topic": {"x": 0.9, mixing.UNKNOWN: 0.1}}).select("mixing.*")
    sums = {r.topic: r.w for r in mixed.groupBy("topic").agg(F.sum(F.col("weight") * F.col("tokens")).alias("w")).collect()}
    assert sums["x"] / sum(sums.values()) == pytest.approx(0.9)


def slow_probabilities(cells, budget):
    """By falling weight: c belongs to the first cell that it doesn't push over 1."""
    whole = sum(t for t, _ in cells)
    order = sorted(cells, key=lambda x: -x[1])
    for k in range(len(order)):
        rest = sum(t * w for t, w in order[k:])
        c = (budget * whole - sum(t for t, _ in order[:k])) / rest
        if c * order[k][1] <= 1:
            return [min(1.0, c * w) for _, w in cells]
    return [1.0] * len(cells)


@pytest.mark.parametrize("budget", [0.1, 0.7, 0.99])
def test_calibration(spark, budget):
    cells = [(10 * k + 1, 0.1 * (k % 7 + 1) ** 3) for k in range(30)]
    rows = spark.createDataFrame([(float(t), w) for t, w in cells], "tokens double, weight double")
    got = {r.tokens: r.probability for r in mixing.calibrate(rows, budget).collect()}
    assert [got[t] for t, _ in cells] == pytest.approx(slow_probabilities(cells, budget))
    zeros = rows.withColumn("weight", F.when(F.col("tokens") < 100, 0.0).otherwise(F.col("weight")))
    got = {r.tokens: r.probability for r in mixing.calibrate(zeros, 0.99).collect()}
    assert all(p == (t >= 100) for t, p in got.items())


def replica(spark, names, data):
    return warc_audit.leaves(spark.createDataFrame([(n, i * 10, d) for n in names for i, d in enumerate(data)], "file string, offset bigint, record string"))


def test_audit_finds_every_kind(spark):
    data = [f"record {i}" for i in range(70)]
    changed = [*data[:17], "damaged", *data[18:65]]
    found = warc_audit.fixity(replica(spark, "ab", data), replica(spark, "a", data).union(replica(spark, "b", changed)), 4)
    odd = sorted((r.file, r.node, r.status) for r in found.filter("status <> 'ok'").collect())
    assert odd == [("b", 17, "corrupt"), *[("b", i, "missing") for i in range(65, 70)]]
    assert found.count() == 140


def test_audit_edges(spark):
    none, one = replica(spark, "", []), replica(spark, "a", [None])
    assert warc_audit.fixity(none, none).count() == 0
    assert [r.status for r in warc_audit.fixity(none, one).collect()] == ["extra"]
    assert [r.status for r in warc_audit.fixity(one, one).collect()] == ["ok"]


def test_only_differing_branches_are_descended(spark):
    data = [f"record {i}" for i in range(300)]
    a = warc_audit.tree(replica(spark, "abc", data), 4)
    assert warc_audit.audit(a, a, 4).count() == 0
    b = warc_audit.tree(replica(spark, "ac", data).union(replica(spark, "b", [*data[:250], "changed", *data[251:]])), 4)
    assert [tuple(r) for r in warc_audit.audit(a, b, 4).collect()] == [("b", 250)]


def test_offsets_are_part_of_the_trees(spark):
    data = [f"record {i}" for i in range(40)]
    rows = [("a", i * 10, d) for i, d in enumerate(data)]
    there = warc_audit.leaves(spark.createDataFrame([(f, o + 7, d) for f, o, d in rows], "file string, offset bigint, record string"))
    found = warc_audit.fixity(replica(spark, "a", data), there).collect()
    assert {r.status for r in found} == {"shifted"} and len(found) == 40 and all(r.other_offset == r.offset + 7 for r in found)


def slow_hash(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def test_roots_against_plain_hashing(spark):
    data = [f"record {i}" for i in range(11)]
    (root,) = [r.hash for r in warc_audit.tree(replica(spark, "a", data), 4)[-1].collect()]
    level = [(i * 10, i * 10 + len(d), slow_hash(i * 10, len(d), hashlib.sha256(d.encode()).hexdigest())) for i, d in enumerate(data)]
    while len(level) > 1:
        groups = [level[i : i + 4] for i in range(0, len(level), 4)]
        level = [(g[0][0], g[-1][1], slow_hash(g[0][0], g[-1][1], len(g), "".join(h for _, _, h in g))) for g in groups]
    assert level[0][2] == root


def test_warc_files(spark):
    pages = spark.createDataFrame([("http://a/é", "<p>ü</p>\r\n\r\nWARC/", 1), (None, None, None), ("http://b\r\nX: y", "x" * 200_000, 3)], "url string, html string, k int")
    rows = pages.select(F.lit("f").alias("file"), F.col("k"), warc_audit.warc_record(F.col("url"), F.col("html"), F.col("k")).alias("record")).union(spark.createDataFrame([("g", 1, None), ("g", 2, "no record")], "file string, k int, record string"))
    records = [r.record.encode() for r in rows.filter("file = 'f'").orderBy("k").collect()]
    files = warc_audit.write_warc(rows, "file", ["k"], "record")
    assert sorted((r.file, r.records) for r in files.collect()) == [("f", 3), ("g", 1)]
    read = warc_audit.read_warc(files).orderBy("file", "node").collect()
    assert [bytes(r.record) for r in read] == [*records, b"no record"] and [r.uri for r in read] == ["", "http://a/é", "http://bX: y", None]
    assert [r.key for r in read] == ["<urn:record:>", "<urn:record:1>", "<urn:record:3>", None]
    assert [r.offset for r in read[:3]] == [0, len(records[0]), len(records[0]) + len(records[1])] and all(r.digest == hashlib.sha256(r.record).hexdigest() for r in read)
    damaged = records[1] + b"junk\r\n\r\n" + records[2][:-4]
    for size in (1, 7, 1 << 20):
        parsed = list(warc_audit.parse_warc(damaged[i : i + size] for i in range(0, len(damaged), size)))
        assert b"".join(r for _, _, r in parsed) == damaged and parsed[0][1]["warc-target-uri"] == "http://a/é" and parsed[1][1] == {}
        assert [o for o, _, _ in parsed] == [sum(len(r) for _, _, r in parsed[:k]) for k in range(len(parsed))]


def test_compressed_files(spark):
    members = []
    for k in range(40):
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        members.append(pack.compress(f"record {k} ".encode() * 30) + pack.flush())
    for size in (5, 100, 1 << 16):
        chunks = lambda data, size=size: (data[i : i + size] for i in range(0, len(data), size))
        assert b"".join(warc_audit.inflated(chunks(b"".join(members)))) == b"".join(f"record {k} ".encode() * 30 for k in range(40))
        broken = b"".join([*members[:3], b"\x1f\x8b\x08" + b"\xff" * 40, *members[4:]])
        assert b"".join(warc_audit.inflated(chunks(broken))).endswith(b"record 39 ") and b"record 4 " in b"".join(warc_audit.inflated(chunks(broken)))
    assert b"".join(warc_audit.inflated([b"plain ", b"text"])) == b"plain text"


def test_query_on_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "<x>"), (37, "u", None), (5, "u", "<x>"), (5, "u", "<x>"), (137, "v", "<y>")], "page_id bigint, url string, html string")
    ours, theirs = (warc_audit.hashed_files(warc_audit.write_warc(warc_audit.page_replica(p, damaged), "file", ["page_id", "tie"], "record")) for p in (pages,) for damaged in (False, True))
    found = warc_audit.fixity(ours, theirs).collect()
    assert len(found) == 6 and sorted(r.status for r in found) == ["corrupt", *["ok"] * 5]
    none = warc_audit.hashed_files(warc_audit.write_warc(warc_audit.page_replica(pages.filter("false"), False), "file", ["page_id", "tie"], "record"))
    assert warc_audit.fixity(none, none).count() == 0 and {r.status for r in warc_audit.fixity(none, ours).collect()} == {"extra"}


def test_texts_of_the_fixture():
    assert None in TEXTS and "" in TEXTS


def records_of(spark, files):
    rows = [(n, i * 10, d, k) for n, data in files.items() for i, (d, k) in enumerate(data)]
    return warc_audit.leaves(spark.createDataFrame(rows, "file string, offset bigint, record string, id string"), key_col="id")


def test_audit_locates_loss_and_insertion(spark):
    data = [(f"record {i}", f"id{i}") for i in range(70)]
    lost = [*data[:20], *data[21:40], ("bad", "id40"), *data[42:]]  # a corrupt record beside a lost one
    more = [*data[:30], ("new", "idnew"), *data[30:]]
    nameless = [*data[:5], ("bad", None), *data[6:]]
    other = records_of(spark, {"a": data, "lost": lost, "more": more, None: nameless})
    found = warc_audit.fixity(records_of(spark, {"a": data, "lost": data, "more": data, None: [(d, None) for d, _ in data]}), other, 4)
    odd = sorted((str(r.file), r.node, r.status) for r in found.filter("status NOT IN ('ok', 'shifted')").collect())
    assert {(r.file, r.node > 20) for r in found.filter("status = 'shifted'").collect()} == {("lost", True), ("more", True)}
    assert odd == [("None", 5, "corrupt"), ("lost", 20, "missing"), ("lost", 40, "corrupt"), ("lost", 41, "missing"), ("more", 30, "extra")]
    assert found.count() == 4 * 70 + 1


def test_pairing():
    plain = lambda text: [(c, None) for c in text]
    odd = lambda a, b: sorted((x for x in warc_audit.pairing(plain(a), plain(b)) if x[2] != "ok"), key=str)
    assert odd("abcdef", "abdefc") == [(2, 5, "moved")]
    assert odd("pxx", "xxr") == [(0, None, "missing"), (None, 2, "extra")]
    assert odd("aXbXc", "aYbXc") == [(1, 1, "corrupt")] and odd("", "") == []
    keyed = warc_audit.pairing([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("x", None), ("c", "3")])
    assert (1, 1, "corrupt") in keyed and len(keyed) == 3  # an identifier that can't be read
    parts = warc_audit.pairing([("b", None), ("d", None)], [("x", None)], ([1, 2], [2]))
    assert sorted(parts, key=str) == [(0, None, "missing"), (1, 0, "corrupt")]
