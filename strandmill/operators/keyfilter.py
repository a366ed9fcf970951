"""A Bloom filter of keys, for tables that would else be shuffled whole to meet a long list of keys.

Tasks set the bits of their keys in parts of their own, which are merged by OR; the filter has a size that is bounded whatever
the number of keys, and goes to all tasks. It lets every key pass that it was made from, and few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.storage import saved

#: Bits for each key, so that about 1 in 1,000 others pass; bits at most (32 MB), beyond which more of them pass.
BITS, MOST = 16, 1 << 28
#: Bits that a key sets; bytes of a part.
HASHES, PART = 4, 1 << 16
#: Letters of an anchor, and of the stretch that has one.
ANCHOR, APART = 24, 8
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    x = keys.view(np.uint64) ^ np.uint64(turn * 0x5851F42D4C957F2D & (1 << 64) - 1)
    for shift in (30, 27):
        x = (x ^ x >> np.uint64(shift)) * _GOLDEN
    return x ^ x >> np.uint64(31)


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each key; bits is a power of two."""
    a, b = mixed(keys, 1), mixed(keys, 2) | np.uint64(1)
    return [(a + np.uint64(i) * b & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the filter."""
    last = np.uint64(len(filter_) * 8 - 1)
    out = np.zeros(len(keys), bool)
    left, at = np.arange(len(keys)), mixed(keys, 1)
    step = None
    for _ in range(HASHES):  # what a bit rules out is not looked at again
        bit = (at & last).astype(np.int64)
        found = np.flatnonzero(filter_[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        left, at = left[found], at[found]
        step = mixed(keys[left], 2) | np.uint64(1) if step is None else step[found]
        at = at + step
    out[left] = True
    return out


def key_filter(keys: DataFrame, n: int, key: str = "key") -> Broadcast:
    """The filter of about n keys, as bytes that tasks have. Nulls are left out."""
    bits = min(MOST, max(PART * 8, 1 << (max(n, 1) * BITS - 1).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in places(batch.column(0).drop_null().to_numpy(), bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        for part in range(0, len(held), PART):
            if held[part : part + PART].any():
                yield pa.record_batch({"part": pa.array([part // PART], pa.int64()), "bytes": pa.array([held[part : part + PART].tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros(PART, np.uint8)
        for data in table["bytes"]:
            out |= np.frombuffer(data.as_buffer(), np.uint8)
        return pa.table({"part": table["part"].slice(0, 1), "bytes": pa.array([out.tobytes()], pa.binary())})

    # A part has one row for each task.
    parts = keys.select(key).mapInArrow(build, "part bigint, bytes binary").groupBy("part").applyInArrow(merge, "part bigint, bytes binary")
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # MOST bits at most
        whole[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.bytes, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def anchor_filter(keys: DataFrame, n: int, k: int, key: str = "key") -> Broadcast | None:
    """The filter of the keys' anchors. Of a record's places every APART-th begins an anchor, and each key of k letters holds the first
    of them at or behind its own place, whole; so a key can only be where an anchor passes, and few places need be looked at. None if
    keys are too short or too many for it."""
    if k < ANCHOR + APART - 1 or n * BITS > MOST:
        return None
    parts = [F.shiftrightunsigned(key, 2 * (k - ANCHOR - j)).bitwiseAND(F.lit((1 << 2 * ANCHOR) - 1)) for j in range(APART)]
    anchors = saved(keys.select(F.explode(F.array(*parts)).alias("anchor")).distinct(), "anchors")
    return key_filter(anchors, anchors.count(), "anchor")
