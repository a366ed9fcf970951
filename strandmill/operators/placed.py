"""Words with their places by super-words: all places of the words that share a key meet in one bucket.

As in superwords.py, runs of neighbours with one minimiser travel as one string of two bits a base; with a run go its first place, its
record and its group (a number that tells genomes and strands apart), as differences from the run before. The minimiser
is that of a word's first `letters` letters, so words that agree in them have one bucket. A bucket with more than SHARE words
is dealt again, word by word, by a hash of those letters. What is made of a bucket's words is up to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.dictionary import dictionary, strided
from strandmill.operators.keyfilter import mixed
from strandmill.operators.kmers import SLICE, WORD, base_codes
from strandmill.operators.superwords import BUCKET, IN_TASK, SHARE, Hot, large_buckets, packed, shared_runs, stretched, unpacked, unzipped, zipped
from strandmill.storage import saved, small

ROW = "bucket bigint, share bigint, n bigint, lengths binary, bases binary, groups binary, seqs binary, places binary"
#: Genomes up to which pairs are made where their words meet.
PAIRED = 500
#: Places from which a word is no matter of one share.
GIANT = SHARE
NUMBERS = ("groups", "seqs", "places")
#: code, group, seq and place of words.
Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def coded(values: np.ndarray) -> bytes:
    """The first of some longs, and the differences of the others in as few bytes each as all fit."""
    steps = np.diff(values)
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values[:1].astype(np.int64).tobytes() + steps.astype(kind).tobytes()


def decoded(data: bytes, n: int) -> np.ndarray:
    first = np.frombuffer(data, np.int64, 1)
    if n == 1:
        return first
    steps = np.frombuffer(data, f"i{(len(data) - 8) // (n - 1)}", n - 1, 8)
    return first + np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def rows_of(bucket: np.ndarray, share: np.ndarray, size: np.ndarray, bases: np.ndarray, begin: np.ndarray, numbers: list[np.ndarray]) -> pa.RecordBatch:
    """ROW: one row for each bucket and share of some runs, whose bases begin at `begin`."""
    order = np.lexsort((share, bucket))
    bucket, share, size, numbers = bucket[order], share[order], size[order], [v[order] for v in numbers]
    n_bytes = -(-(size + WORD - 1) // 4)
    bases = bases[stretched(begin[order], n_bytes)]
    cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (share[1:] != share[:-1])))
    stops, lengths, at = np.append(cuts[1:], len(bucket)), size.astype(np.uint8), np.append(0, np.cumsum(n_bytes))
    parts = list(zip(cuts.tolist(), stops.tolist(), strict=True))
    data = {"bucket": pa.array(bucket[cuts]), "share": pa.array(share[cuts]), "n": pa.array(np.add.reduceat(size, cuts))}
    data |= {"lengths": pa.array([lengths[a:b].tobytes() for a, b in parts], pa.binary()), "bases": pa.array([bases[at[a] : at[b]].tobytes() for a, b in parts], pa.binary())}
    return pa.record_batch(data | {c: pa.array([coded(v[a:b]) for a, b in parts], pa.binary()) for c, v in zip(NUMBERS, numbers, strict=True)})


def _closed(data: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(data).to_bytes(8, "little") + zipped(data)


def _opened(data: bytes) -> bytes:
    return bytes(unzipped(data[8:], int.from_bytes(data[:8], "little")))


def placed_runs(sequences: DataFrame, buckets: int, letters: int = WORD, mask: str = "skip", at_once: int = 4 * SLICE, hot: Hot | None = None, unplaced: bool = False) -> DataFrame:
    """ROW. sequences: dna, seq, g_off and group (a long). at_once: words, about, whose runs a task packs together; hot: large buckets, to be dealt in
    shares; unplaced: without places, and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_parts, held, n_held, offset = [], 0, [], 0, 0

        def cut() -> None:
            """Runs of some pieces of records, between which a letter stands that is no base."""
            nonlocal parts, n_parts, n_held, offset
            whole = base_codes(np.frombuffer(b"\n".join(p[0] for p in parts), np.uint8), mask)
            first, size, bucket, share = shared_runs(whole, buckets, hot, letters)
            if len(first):
                starts = np.cumsum([0] + [len(p[0]) + 1 for p in parts[:-1]])
                of = np.searchsorted(starts, first, "right") - 1
                group, seq, place = (np.array([p[i] for p in parts], np.int64)[of] for i in (1, 2, 3))
                bases = packed(whole, first, size)
                n_bytes = -(-(size + WORD - 1) // 4)
                held.append((bucket, share, size, bases, offset + np.cumsum(n_bytes) - n_bytes, group, seq, place * 0 if unplaced else place + first - starts[of]))
                offset, n_held = offset + len(bases), n_held + int(size.sum())
            parts, n_parts = [], 0

        def told() -> pa.RecordBatch:
            nonlocal held, n_held, offset
            bucket, share, size, bases, begin, *numbers = (np.concatenate(c) for c in zip(*held, strict=True))
            held, n_held, offset = [], 0, 0
            rows = rows_of(bucket, share, size, bases, begin, numbers)
            if not unplaced:
                return rows
            return pa.RecordBatch.from_arrays([pa.array([_closed(v) for v in c.to_pylist()], c.type) if pa.types.is_binary(c.type) else c for c in rows.columns], names=rows.schema.names)

        for batch in batches:
            own = (batch.column(c).to_pylist() for c in ("group", "seq", "g_off"))
            for dna, group, seq, off in zip(batch.column("dna").cast(pa.binary()), *own, strict=True):
                bases = memoryview(dna.as_buffer()) if dna.is_valid else b""
                for a in range(0, max(len(bases) - WORD + 1, 0), SLICE):
                    parts.append((bases[a : a + SLICE + WORD - 1], group, seq, off + a))
                    n_parts += len(parts[-1][0])
                    if n_parts >= SLICE:
                        cut()
                        if n_held >= at_once:
                            yield told()
        if parts:
            cut()
        if held:
            yield told()

    return sequences.select("dna", "group", "seq", "g_off").mapInArrow(run, ROW)


def words_in(row: dict) -> Words:
    """The words of a row's runs."""
    lengths = np.frombuffer(row["lengths"], np.uint8)
    size = lengths.astype(np.int64)
    group, seq, place = (decoded(row[c], len(size)) for c in NUMBERS)
    return unpacked(lengths, np.frombuffer(row["bases"], np.uint8)), np.repeat(group, size), np.repeat(seq, size), stretched(place, size)


def _dealt_again(letters: int, without: np.ndarray | None = None):
    """Rows of large buckets, with their numbers of shares, to rows of single words by shares; some words may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, *numbers = words_in(row)
                if without is not None and len(without):
                    kept = ~np.isin(code, without)
                    code, numbers = code[kept], [v[kept] for v in numbers]
                if not len(code):
                    continue
                share = (mixed(code >> np.uint64(2 * (WORD - letters)), 4) % np.uint64(row["shares"])).astype(np.int64)
                n = len(code)
                yield rows_of(np.full(n, row["bucket"]), share, np.ones(n, np.int64), np.frombuffer(code.astype(">u8").tobytes(), np.uint8), np.arange(n) * 8, numbers)

    return run


def _each_bucket(make: Callable, closed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["bucket"], row["share"]) != key:
                    if own is not None:
                        yield from own.done()
                    key, own = (row["bucket"], row["share"]), make()
                own.add(words_in({c: _opened(v) if closed and isinstance(v, bytes) else v for c, v in row.items()}))
        if own is not None:
            yield from own.done()

    return run


def _written(sequences: DataFrame, letters: int, mask: str) -> tuple[DataFrame, DataFrame]:
    """The runs, and the buckets with over SHARE words, with their numbers of shares."""
    total = sequences.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    buckets = max(4 * int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    rows = saved(placed_runs(sequences, buckets, letters, mask), "runs")
    hot = rows.groupBy("bucket").agg(F.ceil(F.sum("n") / BUCKET).cast("bigint").alias("shares"), F.sum("n").alias("words"))
    return rows, saved(hot.filter(F.col("words") > SHARE).drop("words"), "hot-buckets")  # one for each SHARE words at most


def _made(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    return rows.repartition("bucket", "share").sortWithinPartitions("bucket", "share").mapInArrow(_each_bucket(make), schema)


def by_buckets(sequences: DataFrame, make: Callable, schema: str, letters: int = WORD, mask: str = "skip") -> DataFrame:
    """What is made of each bucket, or share of a large one: make() has add(words) and done(), which gives record batches of the schema.
    sequences: dna, len, seq, g_off and group."""
    rows, hot = _written(sequences, letters, mask)
    if hot.limit(1).count():
        few = small(hot)
        again = rows.join(few, "bucket").mapInArrow(_dealt_again(letters), ROW)
        rows = rows.join(few, "bucket", "left_anti").unionByName(again)
    return _made(rows, make, schema)


def counted_by_buckets(sequences: DataFrame, make: Callable, schema: str, mask: str = "skip") -> DataFrame:
    """What is made of the words and groups of each bucket, without records and places, by a make() whose memory holds different words only: large buckets
    are dealt by a longer minimiser, as for counts of words. sequences: dna, len and group; they are read twice, and words are written once, by the shuffle."""
    total = sequences.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * tasks, -(-total // BUCKET))
    hot = large_buckets(sequences, buckets, WORD, mask, SHARE, BUCKET)
    nowhere = F.lit(0).cast("bigint")
    own = sequences.select("dna", "group", nowhere.alias("seq"), nowhere.alias("g_off"))
    rows = placed_runs(own, buckets, WORD, mask, hot=hot, unplaced=True)
    n = (buckets + int(hot[1].sum())) // IN_TASK
    rows = rows.repartition(n, "bucket", "share") if n > tasks else rows.repartition("bucket", "share")
    return rows.sortWithinPartitions("bucket", "share").mapInArrow(_each_bucket(make, closed=True), schema)


def strided_words(sequences: DataFrame, least: int, cap: int, mask: str = "skip") -> DataFrame:
    """code, seq, pos and num: of each word with `least` places or more every (num div cap)-th place, by place. A word with over GIANT
    places, which no share would hold, is numbered in ranges of the genome."""
    rows, hot = _written(sequences.withColumn("group", F.lit(0).cast("bigint")), WORD, mask)
    schema = "code bigint, seq bigint, pos bigint, num bigint"
    if not hot.limit(1).count():
        return _made(rows, lambda: Strided(least, cap), schema)
    few = small(hot)
    own = rows.join(few, "bucket")
    counts = own.mapInArrow(_repeated, "code bigint, num bigint").groupBy("code").agg(F.sum("num").alias("num")).filter(F.col("num") > GIANT)
    giants = np.array([r["code"] for r in counts.select("code").collect()], np.int64).view(np.uint64)  # one for each GIANT words at most
    rest = rows.join(few, "bucket", "left_anti").unionByName(own.mapInArrow(_dealt_again(WORD, giants), ROW))
    out = _made(rest, lambda: Strided(least, cap), schema)
    if not len(giants):
        return out
    words = saved(own.mapInArrow(_only(giants), "code bigint, seq bigint, pos bigint"), "giant-words")
    counted = saved(words.join(F.broadcast(dictionary(words).filter(F.col("num") >= least)), "code"), "giant-words")
    return out.unionByName(strided(counted, cap).select("code", "seq", "pos", "num"))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that come more than once in a row, and how often: all of which there may be very many places."""
    for batch in batches:
        for row in batch.to_pylist():
            code, n = np.unique(words_in(row)[0], return_counts=True)
            yield pa.record_batch({"code": pa.array(code[n > 1].view(np.int64)), "num": pa.array(n[n > 1])})


def _only(giants: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, _, seq, place = words_in(row)
                own = np.isin(code, giants)
                yield pa.record_batch({"code": pa.array(code[own].view(np.int64)), "seq": pa.array(seq[own]), "pos": pa.array(place[own])})

    return run


def run_starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where another value begins among sorted rows."""
    change = np.zeros(max(len(sorted_[0]) - 1, 0), bool)
    for v in sorted_:
        change |= v[1:] != v[:-1]
    return np.flatnonzero(np.append(True, change)) if len(sorted_[0]) else np.empty(0, np.int64)


class Frequent:
    """Words of a bucket, without those that have over fl places in their group. Of such a word one row is kept, with
    its count, so that memory stays bounded however often it comes."""

    #: Words that are taken in before they are counted.
    AT_ONCE = 1 << 22

    def __init__(self, fl: int):
        self.fl, self.waiting, self.n, self.kept = fl, [], 0, 0

    def add(self, words: Words) -> None:
        self.waiting.append((*words, np.ones(len(words[0]), np.int64)))
        self.n += len(words[0])
        if self.n - self.kept >= self.AT_ONCE:
            self.waiting = [self.counted(self.taken())]
            self.n = self.kept = len(self.waiting[0][0])

    def taken(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*self.waiting, strict=True))

    def counted(self, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The rows sorted by code and group; the last column is the count of those that are too frequent, else 1."""
        if not len(rows[0]):
            return rows
        order = np.lexsort((rows[1], rows[0]))
        rows = tuple(c[order] for c in rows)
        starts = run_starts(rows[0], rows[1])
        sizes, counts = np.diff(np.append(starts, len(order))), np.add.reduceat(rows[4], starts)
        often = np.repeat(counts > self.fl, sizes)
        keep = ~often
        keep[starts] = True
        rows[4][starts] = np.where(counts > self.fl, counts, 1)
        return tuple(c[keep] for c in rows)

    def words(self, shift: int) -> Words:
        """All that may meet others: their keys (codes without the last bits) come more than once."""
        rows = self.taken()
        key = rows[0] >> np.uint64(shift)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        rows = self.counted(tuple(c[order[np.append(False, same) | np.append(same, False)]] for c in rows))
        return tuple(c[rows[4] <= self.fl] for c in rows[:4])


class Pairing(Frequent):
    """Hits between the groups of a bucket that are wanted with each other. A group is twice the genome's number, and one more for
    the reverse strand; wanted: for each genome whether each other one is."""

    #: Pairs of groups, and hits, that are made at a time.
    PAIRS, HITS = 1 << 21, 1 << 19

    def __init__(self, fl: int, k: int, wanted: np.ndarray, names: list[str]):
        super().__init__(fl)
        self.shift, self.wanted, self.names = 2 * (WORD - k), wanted, names

    def done(self) -> Iterator[pa.RecordBatch]:
        code, group, seq, place = self.words(self.shift)
        key = code >> np.uint64(self.shift)
        order = self.ordered(key, group, place)
        key, group, seq, place = (c[order] for c in (key, group, seq, place))
        begin = run_starts(key, group)
        if not len(begin):
            return
        n, of = np.diff(np.append(begin, len(key))), group[begin]
        first = run_starts(key[begin])
        members = np.diff(np.append(first, len(begin)))
        own_first, own_members = np.repeat(first, members), np.repeat(members, members)
        forward = np.flatnonzero(of % 2 == 0)
        made = np.cumsum(own_members[forward])
        for a in within(made, self.PAIRS):
            mine = forward[slice(*a)]
            left, right = np.repeat(mine, own_members[mine]), stretched(own_first[mine], own_members[mine])
            met = self.wanted[of[left] // 2, of[right] // 2]
            left, right = left[met], right[met]
            ends = np.cumsum(n[left] * n[right])
            for low in range(0, int(ends[-1]) if len(ends) else 0, self.HITS):
                at = np.arange(low, min(low + self.HITS, int(ends[-1])))
                pair = np.searchsorted(ends, at, "right")
                x, y = left[pair], right[pair]
                at -= ends[pair] - n[x] * n[y]
                i, j = begin[x] + at // n[y], begin[y] + at % n[y]
                yield self.told(of[x], of[y], place[i], place[j], seq[i], seq[j])

    def ordered(self, key: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.lexsort((group, key))

    def told(self, gx, gy, px, py, sx, sy) -> pa.RecordBatch:
        names, strands = pa.array(self.names, pa.string()), pa.array(["f", "r"])
        columns = {"genome_x": names.take(pa.array(gx // 2)), "genome_y": names.take(pa.array(gy // 2)), "strand": strands.take(pa.array(gy % 2))}
        return pa.record_batch(columns | {"diag": pa.array(px - py), "posX": pa.array(px), "posY": pa.array(py), "seqX": pa.array(sx), "seqY": pa.array(sy)})


class RunPairing(Pairing):
    """The same hits in runs: of those that follow each other on a diagonal, the first, and n, how many they are."""

    def ordered(self, key: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """By the first place of each key: hits of neighbouring words are made together."""
        order = np.lexsort((place, group, key))
        first = run_starts(key[order])
        leaders = order[first]
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((place[leaders], group[leaders]))] = np.arange(len(first))
        rank = np.repeat(rank, np.diff(np.append(first, len(order))))
        return order[np.argsort(rank, kind="stable")]

    def told(self, gx, gy, px, py, sx, sy) -> pa.RecordBatch:
        pair, diag = gx * (2 * len(self.names)) + gy, px - py
        order = np.lexsort((px, diag, pair))
        pair, diag, at, x, y = (c[order] for c in (pair, diag, px, sx, sy))
        begin = run_starts(pair, diag, at - np.arange(len(at)), x, y)
        first = order[begin]
        told = super().told(*(c[first] for c in (gx, gy, px, py, sx, sy)))
        return told.append_column("n", pa.array(np.diff(np.append(begin, len(order)))))


class Shared(Frequent):
    """genome_x, genome_y, shared_words and n_hits of the words of a bucket, for every two of its groups, which are genomes by number in
    the order of their names."""

    PAIRS = 1 << 21

    def __init__(self, fl: int, names: list[str]):
        super().__init__(fl)
        self.names = names

    def add(self, words: Words) -> None:
        """Words of one genome are counted at once: no place is needed."""
        self.waiting.append((*words[:2], np.ones(len(words[0]), np.int64)))
        self.n += len(words[0])
        if self.n - self.kept >= self.AT_ONCE:
            self.waiting = [self.summed()]
            self.n = self.kept = len(self.waiting[0][0])

    def summed(self) -> tuple[np.ndarray, ...]:
        code, group, n = self.taken()
        order = np.lexsort((group, code))
        code, group, n = code[order], group[order], n[order]
        starts = run_starts(code, group)
        return code[starts], group[starts], np.add.reduceat(n, starts)

    def done(self) -> Iterator[pa.RecordBatch]:
        code, group, n = self.summed()
        few = n <= self.fl
        code, group, n = code[few], group[few], n[few]
        first = run_starts(code)
        behind = np.repeat(np.append(first[1:], len(code)), np.diff(np.append(first, len(code)))) - np.arange(len(code)) - 1
        made, g = np.cumsum(behind), len(self.names)
        shared, hits = np.zeros(g * g, np.int64), np.zeros(g * g, np.int64)
        for a, b in within(made, self.PAIRS):
            own = np.arange(a, b)
            left, right = np.repeat(own, behind[a:b]), stretched(own + 1, behind[a:b])
            at = group[left] * g + group[right]
            np.add.at(shared, at, 1)
            np.add.at(hits, at, n[left] * n[right])
        at, names = np.flatnonzero(shared), pa.array(self.names, pa.string())
        yield pa.record_batch({"genome_x": names.take(pa.array(at // g)), "genome_y": names.take(pa.array(at % g)), "shared_words": pa.array(shared[at]), "n_hits": pa.array(hits[at])})


class Strided:
    """The words of a bucket with `least` places or more: of each, every (num div cap)-th place, by place."""

    ROWS = 1 << 18

    def __init__(self, least: int, cap: int):
        self.least, self.cap, self.waiting = least, cap, []

    def add(self, words: Words) -> None:
        self.waiting.append((words[0], words[2], words[3]))

    def done(self) -> Iterator[pa.RecordBatch]:
        code, seq, place = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((place, code))
        code, seq, place = code[order], seq[order], place[order]
        starts = run_starts(code)
        num = np.diff(np.append(starts, len(code)))
        rank, num = np.arange(len(code)) - np.repeat(starts, num), np.repeat(num, num)
        kept = np.flatnonzero((num >= self.least) & (rank % np.maximum(num // self.cap, 1) == 0))
        for a in range(0, len(kept), self.ROWS):
            own = kept[a : a + self.ROWS]
            yield pa.record_batch({"code": pa.array(code[own].view(np.int64)), "seq": pa.array(seq[own]), "pos": pa.array(place[own]), "num": pa.array(num[own])})


def within(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` in all, each at least one row; ends: running sums."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
