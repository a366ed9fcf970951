"""Damaged media and archives, alignment of repeated records, and operators in several threads."""

import random
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from strandmill.llm import common, media, mixing, warc_audit

ODD_IMAGES = [
    b"P5 " + b"9" * 21 + b" 4 255\n" + bytes(16),
    b"P4 " + b"9" * 21 + b" 1\n" + bytes(16),
    b"P6 99999999 99999999 255\n" + bytes(16),
    b"P1 999999 999999\n1 0",
    b"P2 2 2 255\n1 2 3 " + b"9" * 23,
    b"P2 2 2 255\n1 2 3 -2",
    b"P3 3000000000 3000000000 255\n1 2 3",
    b"P2 2 2 99999999999999999999999\n1 2 3 4",
    media.struct.pack("<2sIHHIIiiHHI", b"BM", 0, 0, 0, 54, 40, 2**31 - 1, -(2**31), 1, 32, 0) + bytes(64),
    media.struct.pack("<2sIHHIIiiHHI", b"BM", 0, 0, 0, 2**32 - 1, 40, 2, 2, 1, 8, 0) + bytes(64),
    b"BM",
    b"P5",
    b"",
]


@pytest.mark.parametrize("data", ODD_IMAGES, ids=range(len(ODD_IMAGES)))
def test_odd_images_are_told_not_raised(data):
    told = media.described(data)
    assert told["error"] and told["media_bytes"] == len(data) and "feature" not in told
    with pytest.raises(ValueError, match="."):
        media.decode(data)


def test_odd_images_in_a_table(spark):
    good = media.text_image(b"some text")
    rows = spark.createDataFrame([(k, d) for k, d in enumerate([*ODD_IMAGES, good, None])], "k int, media binary")
    told = {r.k: r.m for r in rows.select("k", media.media_features(F.col("media")).alias("m")).collect()}
    assert told[len(ODD_IMAGES)].feature and told[len(ODD_IMAGES) + 1] is None and all(told[k].error for k in range(len(ODD_IMAGES)))


def test_leading_zeros_are_numbers():
    image, most = media.decode(b"P2 0002 00000000000001 0255\n007 255")
    assert image.tolist() == [[7, 255]] and most == 255


def rising(pairs):
    return all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_repeated_records_are_aligned_in_little_time():
    a, b = ["x", "y"] * 10_000, ["x", "x", "y", "y"] * 5_000
    began = time.perf_counter()
    pairs = warc_audit.common_places(a, b)
    assert time.perf_counter() - began < 20 and rising(pairs) and len(pairs) >= 10_000
    rows = warc_audit.pairing([(d, None) for d in a], [(d, None) for d in b])
    assert len(rows) == 20_000 and {s for *_, s in rows} <= {"ok", "moved"}


@pytest.mark.parametrize("seed", range(20))
def test_alignment_of_few_contents(seed):
    r = random.Random(seed)
    a = [r.choice("xyz") for _ in range(60)]
    b = [c for c in a if r.random() < 0.9] + ["x"] * r.randrange(3)
    pairs = warc_audit.common_places(a, b)
    assert rising(pairs) and all(a[i] == b[j] for i, j in pairs)
    told = warc_audit.pairing([(d, None) for d in a], [(d, None) for d in b])
    assert sorted(i for i, _, _ in told if i is not None) == list(range(len(a))) and sorted(j for _, j, _ in told if j is not None) == list(range(len(b)))


def test_a_damaged_member_stays_a_record():
    records = [f"WARC/1.0\r\nWARC-Record-ID: {k}\r\nContent-Length: 500\r\n\r\n".encode() + bytes([65 + k]) * 500 + b"\r\n\r\n" for k in range(5)]
    members = []
    for record in records:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        members.append(pack.compress(record) + pack.flush())
    cut = members[2][:12] + bytes(b ^ 0x5A for b in members[2][12:-2]) + members[2][-2:]
    data = b"".join([*members[:2], cut, *members[3:]])
    for size in (7, 100, 1 << 16):
        chunks = (data[i : i + size] for i in range(0, len(data), size))
        read = list(warc_audit.parse_warc(warc_audit.inflated(chunks)))
        assert [h.get("warc-record-id") for _, h, _ in read if h] == ["0", "1", "3", "4"] and len(read) == 5
        assert [r for _, h, r in read if h] == [records[k] for k in (0, 1, 3, 4)] and read[2][1] == {}


def test_null_identifiers_lie_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "FILE_RECORDS", 10)
    pages = spark.createDataFrame([(None, "u", "<x>")] * 60 + [(None, f"u{k}", None) for k in range(40)] + [(7, "v", "<y>")], "page_id bigint, url string, html string")
    ours, theirs = (warc_audit.hashed_files(warc_audit.write_warc(warc_audit.page_replica(pages, damaged), "file", ["page_id", "tie"], "record")) for damaged in (False, True))
    found = warc_audit.fixity(ours, theirs).collect()
    assert len(found) == 101 and {r.status for r in found} == {"ok"} and len({r.file for r in found}) > 5


def test_threads_keep_their_own_tables(spark):
    errors = []

    def work(k):
        try:
            for _ in range(3):
                out = common.materialized_from(spark, lambda: common.materialize(spark.range(50).withColumn("k", F.lit(k)), "inner"), "outer")
                time.sleep(0.1)
                assert out.filter(F.col("k") == k).count() == 50
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_targets_that_cannot_be_met_are_told(spark):
    """Each source has a language of its own, so their targets contradict each other."""
    cells = spark.createDataFrame([("a", "en", "t", 10, 1), ("b", "de", "t", 10, 1)], "source string, lang string, topic string, tokens bigint, documents bigint")
    with pytest.warns(UserWarning, match="missed by 0.4"):
        mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, 3)
