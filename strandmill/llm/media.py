"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, resized by area with integral images, and
written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, named, pieces, table

#: Samples in a row of the images that hold a payload; edge of a tile; samples summed up at a time.
WIDTH, TILE, BLOCK = 64, 16, 1 << 18
_GAP = rb"(?:\s|#[^\n]*\n)+"
_HEADER = re.compile(rb"P([1-6])" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)")
_MAXVAL = re.compile(_GAP + rb"(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary PGM (P5) of a two-dimensional uint8 array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """BMP with an 8-bit grey palette; rows from the bottom up, padded to 4 bytes."""
    h, w = samples.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Array of height x width (P1, P2, P4, P5) or height x width x 3 (P3, P6), and the greatest value that a
    sample may have; 16-bit samples if that is over 255. Bitmaps have 1 for white."""
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, w, h = int(m[1]), number(m[2]), number(m[3])
    at, most = m.end(), 1
    if kind not in (1, 4):
        n = _MAXVAL.match(data, at)
        if not n or not 0 < number(n[1]) < 1 << 16:
            raise ValueError("no valid greatest value")
        at, most = n.end(), number(n[1])
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    size = h * w * (3 if kind in (3, 6) else 1)
    # Bytes that so many samples take at least: made-up sizes are refused before anything is allocated.
    if (h * -(-w // 8) if kind == 4 else size * (2 if kind > 4 and most > 255 else 1)) > len(data) - at:
        raise ValueError("the image is larger than its data")
    if kind == 1:  # digits may touch each other
        found = np.frombuffer(re.sub(rb"#[^\n]*|[^01]", b"", data[at:]), np.uint8)[:size]
        return (ord("1") - found).reshape(shape), most
    if kind < 4:
        found = np.array([number(x) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:size]], np.int64)
        return checked(found, most).astype(np.uint16 if most > 255 else np.uint8).reshape(shape), most
    at += 1  # one white space
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -(-w // 8))
        return 1 - np.unpackbits(rows, axis=1)[:, :w], most
    return checked(np.frombuffer(data, np.dtype(">u2" if most > 255 else "u1"), size, at), most).reshape(shape), most


def number(digits: bytes) -> int:
    """A whole number of up to ten digits, leading zeros aside; nothing else is one."""
    if not digits.isdigit() or len(digits.lstrip(b"0")) > 10:
        raise ValueError("not a number of an image")
    return int(digits)


def checked(samples: np.ndarray, most: int) -> np.ndarray:
    if len(samples) and int(samples.max()) > most:
        raise ValueError("a sample is over the greatest value")
    return samples


def decode_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """Array of height x width (a palette of greys) or height x width x 3 in RGB order, of 1, 4, 8, 16 (five
    bits a colour, scaled up), 24 or 32 bits, uncompressed; and 255."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 16, 24, 32) or w <= 0:
        raise ValueError(f"BMP with {bits} bits and compression {packed}")
    stride = (w * bits + 31) // 32 * 4
    if stride * abs(h) > len(data) - at:
        raise ValueError("the image is larger than its data")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1], 255
    if bits == 16:
        pairs = np.ascontiguousarray(rows[:, : 2 * w]).view("<u2")
        return np.stack([(pairs >> k & 31) * 255 // 31 for k in (10, 5, 0)], axis=2).astype(np.uint8), 255
    index = rows if bits == 8 else np.stack([rows >> k & (1 << bits) - 1 for k in range(8 - bits, -1, -bits)], axis=2).reshape(abs(h), -1)
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    colours = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
    index = index[:, :w]
    if index.size and int(index.max()) >= used:
        raise ValueError("a sample is beyond the palette")
    return (colours[:, 0][index] if (colours == colours[:, :1]).all() else colours[index]), 255


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and their greatest value; ValueError for bytes that are no image of these kinds."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"damaged image: {e}") from e


def integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted rows of the integral image, which has one row and column more than the image; a block of
    the image's rows is summed up at a time."""
    h, w = image.shape
    out, before = np.zeros((len(wanted), w + 1)), np.zeros(w)
    step = max(1, BLOCK // max(w, 1))
    for a in range(0, h, step):
        sums = before + np.cumsum(image[a : a + step], axis=0, dtype=np.float64)
        inside = (wanted > a) & (wanted <= a + len(sums))
        out[inside, 1:] = sums[wanted[inside] - a - 1]
        before = sums[-1]
    return np.cumsum(out, axis=1, out=out)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area of a two-dimensional image, from its integral image; a cell's
    edges may lie within samples."""
    h, w = image.shape

    def edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * (size / cells)
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, (edge - low)[:, None]

    low, part = edges(h, height)
    sums = integral_rows(image, low) * (1 - part) + integral_rows(image, low + 1) * part
    rows = np.diff(sums, axis=0)
    low, part = edges(w, width)
    return np.diff(rows.T[low] * (1 - part) + rows.T[low + 1] * part, axis=0).T * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 area means is below its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(image: np.ndarray, most: int = 255, edge: int = TILE) -> bytes:
    """NPY bytes of the image resized to edge x edge uint8, `most` becoming 255."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(image, edge, edge) * (255 / most)).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.mean(axis=2)


FEATURES = {"height": pa.int32(), "width": pa.int32(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary(), "error": pa.string()}
_KIND = "struct<height: int, width: int, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string, tile: binary, error: string>"


def described(data: bytes) -> dict:
    """FEATURES of one image: digests of its bytes and of its samples, difference hash and tile. What can't be
    decoded has media_bytes, media_sha256 and error only."""
    stored = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        image, most = decode(data)
        if not image.size:
            raise ValueError("an image without samples")
    except ValueError as e:
        return stored | {"error": str(e)}
    payload, plain = image.tobytes(), grey(image)
    shape = {"height": image.shape[0], "width": image.shape[1], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
    return stored | shape | {"tail_crc32": zlib.crc32(payload[-64:]), "feature": difference_hash(plain), "tile": tile(plain, most)}


def media_features(media: Column) -> Column:
    """Struct of FEATURES, null for null media: never the samples themselves, so that a row stays small."""

    @F.arrow_udf(_KIND)
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [None if data is None else described(data) for part in pieces(batch) for data in part.to_pylist()]
            yield pa.array(rows, pa.struct(list(FEATURES.items())))

    return features(media)


def text_image(text: bytes) -> bytes:
    """PGM of the text's bytes, padded with zeros to a positive multiple of WIDTH."""
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return encode_pgm(np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH))


def text_media(text: Column) -> Column:
    @F.arrow_udf("binary")
    def images(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([text_image(x or b"") for part in pieces(batch) for x in part.cast(pa.binary()).to_pylist()], pa.binary())

    return images(text)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table of id_col, n_bytes and media, written to the shared folder and read back: the UTF-8 bytes of
    each text as an image. Null counts as empty (one row of zeros); repeated rows are stored each."""
    text = F.coalesce(named(text_col), F.lit(""))
    return materialize(docs.select(named(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), text_media(text).alias("media")), "media", "zstd")


def tile_table(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """stored with the fields of media_features (replaced if there are any) in place of the media, written to
    the shared folder: NPY tiles, difference hashes and digests of each row."""
    others = [named(c) for c in stored.columns if c not in (media_col, *FEATURES)]
    return materialize(stored.select(*others, media_features(named(media_col)).alias("media")).select(*others, "media.*"), "tiles", "zstd")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tiles' table tells of documents stored as images. Null texts count as empty (one row of
    zeros), repeated rows are stored each, an empty table gives no rows."""
    tiles = tile_table(store_texts(table(spark, sf_dir, "documents")))
    return tiles.select("doc_id", "n_bytes", *list(FEATURES)[2:8], F.sha2("tile", 256).alias("tile_sha256"))


QUERIES = {"op4_media": op4_media}
ORACLES: dict[str, str] = {}
