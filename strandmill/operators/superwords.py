"""Counts of words by super-words: neighbouring words travel together.

The minimiser of a word is the least, by a mixed order, of the shorter words in it. Neighbours mostly have the same one, and
all places of a word have the same, so runs of neighbours with one minimiser go to its bucket as one string of two bits a base,
about a byte a word, and are cut into words and counted there. A task packs all runs of one bucket that it has among some millions of words
into one row and compresses it: runs of a bucket are alike. The words of each bucket are counted first, without writing them; those of buckets with very many
are dealt into shares by a longer minimiser, again in runs. So words are written once, by the one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.keyfilter import mixed
from strandmill.operators.kmers import SLICE, WORD, base_codes, words_of

#: Letters of a minimiser; words of a run at most.
SHORT, RUN = 12, 200
#: Letters of the minimiser by which large buckets are dealt; words, about, that a task packs together.
LONG, PACKED = 20, 1 << 24
#: Words of a bucket, about, and of one that isn't cut into shares; words that are cut at a time.
BUCKET, SHARE, AT_ONCE = 1 << 21, 1 << 23, 1 << 21
#: Buckets whose rows a task sorts, about: a byte a word.
IN_TASK = 32
ROW = "bucket bigint, share bigint, n bigint, runs bigint, lengths binary, bases binary"
#: Large buckets, sorted, and their numbers of shares.
Hot = tuple[np.ndarray, np.ndarray]


def runs(codes: np.ndarray, buckets: int, letters: int = WORD, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and bucket of each run of base codes (over 3: no base). letters: minimisers are those of so many
    first letters of a word; longest: letters of a minimiser, SHORT if None."""
    n = len(codes) - WORD + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    valid = bad[WORD:] == bad[:-WORD]
    own, short, wide = min(longest or SHORT, letters), codes.astype(np.uint64) & np.uint64(3), 1
    while wide < own:  # words of SHORT letters from shorter ones
        step = min(wide, own - wide)
        short = short[: len(short) - step] << np.uint64(2 * step) | (short[step:] & np.uint64((1 << 2 * step) - 1))
        wide += step
    least, span = mixed(short.view(np.int64), 3), 1
    window = letters - own + 1
    while span < window:  # minima of windows from narrower ones
        step = min(span, window - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    least = least[:n]
    change = np.flatnonzero((least[1:] != least[:-1]) | ~valid[1:] | ~valid[:-1]) + 1
    begin = np.concatenate([[0], change])
    length = np.diff(np.append(begin, n))
    begin, length = begin[valid[begin]], length[valid[begin]]
    parts = -(-length // RUN)  # long runs, as of one letter, are cut
    first = np.repeat(begin, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
    size = np.minimum(np.repeat(begin + length, parts) - first, RUN)
    return first, size, (least[first] % np.uint64(buckets)).astype(np.int64)


def stretched(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of each run of length[i]."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def packed(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bases of runs, four to a byte; each run begins at a byte."""
    length = size + WORD - 1
    held = -(-length // 4)
    out = np.zeros(4 * int(held.sum()), np.uint8)
    out[stretched(4 * (np.cumsum(held) - held), length)] = codes[stretched(first, length)]
    out = out.reshape(-1, 4)
    return out[:, 0] << 6 | out[:, 1] << 4 | out[:, 2] << 2 | out[:, 3]


def unpacked(lengths: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """The words of packed runs."""
    size = lengths.astype(np.int64)
    held = -(-(size + WORD - 1) // 4)
    codes = (bases[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()
    return words_of(codes)[stretched(4 * (np.cumsum(held) - held), size)]


def shared_runs(codes: np.ndarray, buckets: int, hot: Hot | None, letters: int = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """runs, and their shares: 0 but in large buckets, whose runs are cut where the longer minimiser changes."""
    first, size, bucket = runs(codes, buckets, letters)
    share = np.zeros(len(first), np.int64)
    if hot is None or not len(hot[0]) or not len(first):
        return first, size, bucket, share
    at = np.minimum(np.searchsorted(hot[0], bucket), len(hot[0]) - 1)
    large = hot[0][at] == bucket
    if not large.any():
        return first, size, bucket, share
    begin, length = first[large], size[large] + WORD
    starts = np.cumsum(length) - length
    own = codes[np.minimum(stretched(begin, length), len(codes) - 1)]
    own[starts + length - 1] = 255  # between two runs
    again, sizes, number = runs(own, 1 << 31, letters, LONG)
    of = np.searchsorted(starts, again, "right") - 1
    parts = (begin[of] + again - starts[of], sizes, bucket[large][of], number % hot[1][at[large][of]])
    return tuple(np.concatenate([c[~large], d]) for c, d in zip((first, size, bucket, share), parts, strict=True))


def zipped(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unzipped(data: pa.Buffer | bytes, n: int) -> pa.Buffer | bytes:
    return pa.decompress(data, n, codec="zstd") if n else b""


def _slices(batches: Iterator[pa.RecordBatch], mask: str) -> Iterator[np.ndarray]:
    """Base codes of stretches of the column dna, with the 31 that follow."""
    for batch in batches:
        for dna in batch.column("dna").cast(pa.binary()):
            whole = base_codes(np.frombuffer(dna.as_buffer(), np.uint8), mask) if dna.is_valid else np.empty(0, np.uint8)
            for a in range(0, max(len(whole) - WORD + 1, 0), SLICE):
                yield whole[a : a + SLICE + WORD - 1]


def large_buckets(sequences: DataFrame, buckets: int, letters: int, mask: str, most: int, each: int) -> Hot:
    """The buckets with over `most` words, and how many shares of `each` they have. Nothing but numbers is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for codes in _slices(batches, mask):
            _, size, bucket = runs(codes, buckets, letters)
            np.add.at(n, bucket, size)
        at = np.flatnonzero(n)
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(n[at])})

    counts = sequences.select("dna").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = counts.filter(F.col("n") > most).toArrow().sort_by("bucket")  # one for each `most` words at most
    return hot["bucket"].to_numpy(), -(-hot["n"].to_numpy() // each)


def super_words(sequences: DataFrame, buckets: int, mask: str = "skip", hot: Hot | None = None) -> DataFrame:
    """ROW: the runs of a bucket, or share of a large one, among some words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = offset = 0

        def told() -> pa.RecordBatch:
            bucket, share, size, data, ends = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((share, bucket))
            bucket, share, size, ends = bucket[order], share[order], size[order], ends[order]
            n_bytes = -(-(size + WORD - 1) // 4)
            cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (share[1:] != share[:-1])))
            lengths, stops = size.astype(np.uint8), np.append(cuts[1:], len(bucket))
            parts = list(zip(cuts.tolist(), stops.tolist(), strict=True))
            return pa.record_batch({
                "bucket": pa.array(bucket[cuts]),
                "share": pa.array(share[cuts]),
                "n": pa.array(np.add.reduceat(size, cuts)),
                "runs": pa.array(stops - cuts),
                "lengths": pa.array([zipped(lengths[a:b].tobytes()) for a, b in parts], pa.binary()),
                "bases": pa.array([zipped(data[stretched(ends[a:b], n_bytes[a:b])].tobytes()) for a, b in parts], pa.binary()),
            })

        for codes in _slices(batches, mask):
            first, size, bucket, share = shared_runs(codes, buckets, hot)
            if not len(first):
                continue
            data = packed(codes, first, size)
            n_bytes = -(-(size + WORD - 1) // 4)
            held.append((bucket, share, size, data, offset + np.cumsum(n_bytes) - n_bytes))
            offset, n_held = offset + len(data), n_held + int(size.sum())
            if n_held >= PACKED:
                yield told()
                held, n_held, offset = [], 0, 0
        if held:
            yield told()

    return sequences.select("dna").mapInArrow(run, ROW)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and share to code and num."""
    key, waiting, n_waiting = None, [], 0
    codes, nums = np.empty(0, np.uint64), np.empty(0, np.int64)

    def added() -> tuple[np.ndarray, np.ndarray]:
        own, n = np.unique(np.concatenate(waiting), return_counts=True)
        if not len(codes):
            return own, n
        own, n = np.concatenate([codes, own]), np.concatenate([nums, n])
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        return own[first], np.add.reduceat(n[order], first)

    def told() -> pa.RecordBatch:
        return pa.record_batch({"code": pa.array(codes.view(np.int64)), "num": pa.array(nums, pa.int64())})

    for batch in batches:
        own = (batch.column(c).to_pylist() for c in ("bucket", "share", "runs"))
        for bucket, share, n, lengths, bases in zip(*own, batch.column("lengths"), batch.column("bases"), strict=True):
            if (bucket, share) != key:
                if waiting or len(codes):
                    codes, nums = added() if waiting else (codes, nums)
                    yield told()
                key, waiting, n_waiting = (bucket, share), [], 0
                codes, nums = np.empty(0, np.uint64), np.empty(0, np.int64)
            size = np.frombuffer(unzipped(lengths.as_buffer(), n), np.uint8)
            n_bytes = int((-(-(size.astype(np.int64) + WORD - 1) // 4)).sum())
            waiting.append(unpacked(size, np.frombuffer(unzipped(bases.as_buffer(), n_bytes), np.uint8)))
            n_waiting += len(waiting[-1])
            if n_waiting >= max(AT_ONCE, len(codes)):
                codes, nums = added()
                waiting, n_waiting = [], 0
    if waiting or len(codes):
        codes, nums = added() if waiting else (codes, nums)
        yield told()


def word_counts(sequences: DataFrame, mask: str = "skip") -> DataFrame:
    """code and num of every word, as dictionary(kmers(sequences)) has them. sequences has len: it tells the number of buckets. They are
    read twice.

    Each task holds one bucket, or share of a large one, at a time, and sorts the rows of IN_TASK buckets or so: neither grows with
    the input."""
    total = sequences.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * tasks, -(-total // BUCKET))
    hot = large_buckets(sequences, buckets, WORD, mask, SHARE, BUCKET)
    rows = super_words(sequences, buckets, mask, hot)
    n = (buckets + int(hot[1].sum())) // IN_TASK
    rows = rows.repartition(n, "bucket", "share") if n > tasks else rows.repartition("bucket", "share")
    return rows.sortWithinPartitions("bucket", "share").mapInArrow(_counted, "code bigint, num bigint")
