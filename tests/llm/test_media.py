"""Image codecs, resizing and the stored texts."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from helpers import TEXTS, empty_documents, odd_documents
from pyspark.sql import functions as F

from strandmill.llm import media

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 64), (64, 3)])
def test_round_trips(shape):
    image = RNG.integers(0, 256, shape, np.uint8)
    for code in (media.encode_pgm, media.encode_bmp):
        back, most = media.decode(code(image))
        assert (back == image).all() and most == 255


def bmp(width, height, bits, palette, rows):
    head = b"BM" + bytes(8) + (54 + len(palette)).to_bytes(4, "little") + (40).to_bytes(4, "little")
    return head + width.to_bytes(4, "little") + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + bytes(16) + (len(palette) // 4).to_bytes(4, "little") + bytes(4) + palette + rows


def test_other_forms():
    def samples(data):
        return media.decode(data)[0].tolist()

    assert samples(b"P1 # c\n3 2\n1 0 1\n#x\n010") == [[0, 1, 0], [1, 0, 1]] and media.decode(b"P1 1 1 0")[1] == 1
    assert samples(b"P2 # c\n2 2\n# x\n255\n1 2\n3 4\n") == [[1, 2], [3, 4]]
    assert samples(b"P3 1 2 9 1 2 3 4 5 9") == [[[1, 2, 3]], [[4, 5, 9]]]
    assert samples(b"P4 9 1 \x80\x80") == [[0, 1, 1, 1, 1, 1, 1, 1, 0]]
    assert media.decode(b"P6 1 2 255 abcdef")[0].shape == (2, 1, 3)
    assert samples(b"P5 1 1 65535 \x01\x02") == [[258]]
    assert samples(bmp(1, 2, 24, b"", b"\x01\x02\x03\x00\x04\x05\x06\x00")) == [[[6, 5, 4]], [[3, 2, 1]]]
    greys = bytes([0, 0, 0, 0, 200, 200, 200, 0])
    assert samples(bmp(3, 1, 1, greys, b"\xa0\0\0\0")) == [[200, 0, 200]]
    assert samples(bmp(3, 1, 4, bytes([7, 8, 9, 0]) + greys, b"\x12\x00\0\0")) == [[[0, 0, 0], [200, 200, 200], [9, 8, 7]]]
    assert samples(bmp(1, 1, 16, b"", (31 << 10 | 1).to_bytes(2, "little") + b"\0\0")) == [[[255, 0, 8]]]
    for bad in (b"", b"P9 1 1 1 x", b"JFIF", b"BM", b"P5 9 9 255 abc", b"P2 1 1 7 8", b"P5 1 1 0 x", bmp(1, 1, 8, greys, b"\x07\0\0\0"), bmp(9, 9, 24, b"", b"x")):
        with pytest.raises(ValueError):  # noqa: PT011
            media.decode(bad)


def slow_resize(image, h, w):
    big = np.repeat(np.repeat(image.astype(float), h, axis=0), w, axis=1)  # each cell takes whole small squares
    return big.reshape(h, image.shape[0], w, image.shape[1]).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (3, 100)])
def test_resize_is_the_mean_over_areas(shape):
    image = RNG.integers(0, 256, shape, np.uint8)
    assert np.allclose(media.area_resize(image, 8, 9), slow_resize(image, 8, 9))


def test_resize_by_blocks(monkeypatch):
    image = RNG.integers(0, 256, (501, 7), np.uint8)
    whole = media.area_resize(image, 16, 16)
    monkeypatch.setattr(media, "BLOCK", 20)
    assert (media.area_resize(image, 16, 16) == whole).all()


def test_tile_and_hash():
    image = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    tile = np.load(io.BytesIO(media.tile(image)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8 and (np.diff(tile.astype(int)) > 0).all()
    assert media.difference_hash(image) == "f" * 16 and media.difference_hash(image[:, ::-1]) == "0" * 16


def test_tiles_are_scaled_to_the_greatest_value():
    for image, most in ((np.full((4, 4), 7, np.uint8), 7), (np.full((4, 4), 65535, ">u2"), 65535), (np.ones((4, 4), np.uint8), 1)):
        assert (np.load(io.BytesIO(media.tile(image, most))) == 255).all()
    assert (np.load(io.BytesIO(media.tile(np.full((4, 4), 300, ">u2"), 1000))) == round(300 * 255 / 1000)).all()


def test_features(spark):
    image = RNG.integers(0, 256, (10, 12), np.uint8)
    rows = [(1, media.encode_pgm(image)), (2, media.encode_bmp(image)), (3, None), (4, b""), (5, b"P5 9 9 255 cut off"), (6, b"P5 0 5 255 ")]
    out = spark.createDataFrame(rows, "id int, m binary").select("id", media.media_features(F.col("m")).alias("f")).orderBy("id").collect()
    assert out[0].f.feature == out[1].f.feature and out[0].f.payload_sha256 == out[1].f.payload_sha256 == hashlib.sha256(image.tobytes()).hexdigest() and out[2].f is None
    assert np.load(io.BytesIO(out[0].f.tile)).shape == (16, 16) and out[0].f.error is None
    assert all(r.f.error and r.f.tile is None and r.f.media_sha256 == hashlib.sha256(m).hexdigest() for r, (_, m) in zip(out[3:], rows[3:], strict=True))


def test_stored_texts(spark):
    docs = odd_documents(spark)
    tiles = media.tile_table(media.store_texts(docs))
    rows = tiles.collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    want, by_payload = [], {}
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        want.append((str(r.doc_id), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        by_payload[hashlib.sha256(payload).hexdigest()] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    assert got == sorted(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature, bytes(r.tile)))
        image = by_payload[r.payload_sha256]
        assert (np.load(io.BytesIO(r.tile)) == np.round(slow_resize(image, 16, 16))).all() if len(image) < 100 else True
        stored = b"P5\n64 %d\n255\n" % len(image) + image.tobytes()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) == len({(t or "").ljust(1, "\0") for t in TEXTS})
    assert media.tile_table(media.store_texts(empty_documents(spark))).count() == 0
    assert media.tile_table(media.store_texts(docs).withColumnRenamed("n_bytes", "tile")).columns[0] == "doc_id"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in media.op4_media(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        data = (d.text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and len(r.feature) == 16
