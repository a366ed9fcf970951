"""Hits of short words, counted or extended where the record of X lies.

Of short words there are far more hits than words, and hardly one of them comes to anything. So they are never written: the words of Y, if
they are few, go to all tasks, and each record of X makes its own hits and sums them up, or thins and extends them and tells only the
accepted fragments. What needs all of X is which of its words are too frequent: those are found by counts of parts. A word with over fl
places has, in one of the parts, more than that part's share of fl; only such suspects are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.dna import code_prefix
from strandmill.operators.dictionary import frequent_enough
from strandmill.operators.extension import EXTENDED, MATCH, UNKNOWN
from strandmill.operators.keyfilter import key_filter, passes
from strandmill.operators.kmers import SLICE, TAKEN, WORD, kmers, pack_words
from strandmill.operators.placed import run_starts
from strandmill.operators.superwords import stretched
from strandmill.operators.thinning import NOWHERE, walked
from strandmill.storage import BROADCAST_ROWS, saved, small

#: Bases of Y's strands, and of a record of X, up to which hits are made record by record; words that are counted at a time; hits that are
#: extended at a time.
MOST_BASES, LONGEST, AT_ONCE, HITS = 1 << 26, 1 << 22, 1 << 24, 1 << 22
#: Bases that are compared in the first step and in the longest one; cells of a comparison.
FIRST, WIDEST, CELLS = 64, 512, 1 << 19
COUNTS = "strand string, seqX bigint, seqY bigint, n bigint"
N = ord("N")


@dataclass
class Few:
    """Words of Y, sorted by key: keys, all different; begin: where the places of each begin, and their number at the end; record (number among
    the strands' records) and pos of each place; n: places that it stands for."""

    keys: np.ndarray
    begin: np.ndarray
    record: np.ndarray
    pos: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, record: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Few:
        order = np.lexsort((pos, record, key))
        key, record, pos, n = key[order], record[order], pos[order], n[order]
        first = run_starts(key)
        return cls(key[first], np.append(first, len(key)), record, pos, n)

    def counted(self) -> Few:
        """One place for each key and record."""
        key = np.repeat(self.keys, np.diff(self.begin))
        first = run_starts(key, self.record)
        n = np.add.reduceat(self.n, first) if len(first) else self.n
        return Few.of(key[first], self.record[first], self.pos[first], n)

    def within(self, low: int, high: int) -> Few:
        own = (self.record >= low) & (self.record < high)
        return Few.of(np.repeat(self.keys, np.diff(self.begin))[own], self.record[own], self.pos[own], self.n[own])

    def met(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of keys, and the places that each meets."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.flatnonzero(self.keys[at] == keys)
        begin, size = self.begin[at[own]], np.diff(self.begin)[at[own]]
        return np.repeat(own, size), stretched(begin, size)


@dataclass
class Setting:
    """What tasks have: the words of Y, a filter of their keys, X's words that are too frequent (sorted), and strand, seq, g_off and length of
    each record of Y's strands; bases of all of them, and where those of each begin, if they are asked for."""

    few: Few
    filter: np.ndarray
    often: np.ndarray
    strand: list[str]
    seq: np.ndarray
    off: np.ndarray
    length: np.ndarray
    bases: np.ndarray | None = None
    begin: np.ndarray | None = None


def suspects(x: DataFrame, keys: Broadcast, k: int, fl: int, mask: str) -> DataFrame:
    """code: words of X that pass the filter of keys, among them all with over fl places."""
    total = x.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_parts, held, n_held, bases = [], 0, [], 0, 0

        def cut() -> None:
            nonlocal parts, n_parts, n_held
            codes = pack_words(np.frombuffer(b"\n".join(parts), np.uint8), mask)[1]
            held.append(codes[passes(keys.value, codes >> np.uint64(2 * (WORD - k)))])
            parts, n_parts, n_held = [], 0, n_held + len(held[-1])

        def told() -> pa.RecordBatch:
            nonlocal held, n_held, bases
            code, n = np.unique(np.concatenate(held), return_counts=True)
            share = fl * bases // max(total, 1)
            held, n_held, bases = [], 0, 0
            return pa.record_batch({"code": pa.array(code[n > share].view(np.int64))})

        for batch in batches:
            for dna in batch.column("dna").cast(pa.binary()):
                whole = memoryview(dna.as_buffer()) if dna.is_valid else b""
                bases += len(whole)
                for a in range(0, max(len(whole) - WORD + 1, 0), SLICE):
                    parts.append(whole[a : a + SLICE + WORD - 1])
                    n_parts += len(parts[-1])
                    if n_parts >= TAKEN:
                        cut()
                if n_held >= AT_ONCE:
                    if parts:
                        cut()
                    yield told()
        if parts:
            cut()
        if held:
            yield told()

    return x.select("dna").mapInArrow(run, "code bigint").distinct()


def setting(x: DataFrame, strands: dict[str, DataFrame], k: int, fl: int, mask: str, with_bases: bool) -> Broadcast | None:
    """None if Y has too many words or bases for all tasks, or X a record that is too long for one. x and strands are read several times:
    pass written tables."""
    longest = x.agg(F.max("len")).first()[0] or 0
    rows = [y.select(F.lit(s).alias("strand"), "seq", "g_off", "len", *["dna"] * with_bases) for s, y in strands.items()]
    rows = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    n_records, n_bases = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    if longest > LONGEST or n_records > BROADCAST_ROWS or (with_bases and n_bases > MOST_BASES):
        return None
    words = [kmers(y, mask).withColumn("strand", F.lit(s)) for s, y in strands.items()]
    words = words[0] if len(words) == 1 else words[0].unionByName(words[1])
    y = saved(frequent_enough(words, fl, ("strand", "code")).withColumn("key", code_prefix(F.col("code"), k)), "words")
    if y.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    keys = key_filter(y.select("key").distinct(), BROADCAST_ROWS)
    held = saved(suspects(x, keys, k, fl, mask), "suspects")
    n, often = held.count(), np.empty(0, np.uint64)
    if n:
        counts = kmers(x, mask, columns=("code",), keys=(key_filter(held, n, "code"), WORD)).join(small(held), "code", "left_semi")
        over = saved(counts.groupBy("code").agg(F.count(F.lit(1)).alias("num")).filter(F.col("num") > fl).select("code"), "too-frequent")
        if over.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return None
        often = np.sort(over.toArrow()["code"].to_numpy().view(np.uint64))
    records = rows.toArrow().sort_by([("strand", "ascending"), ("seq", "ascending")])
    strand, seq = records["strand"].to_pylist(), records["seq"].to_numpy()
    at = {(s, i): r for r, (s, i) in enumerate(zip(strand, seq.tolist(), strict=True))}
    table = y.select("key", "strand", "seq", "pos").toArrow()
    record = np.array([at[r] for r in zip(table["strand"].to_pylist(), table["seq"].to_pylist(), strict=True)], np.int64)
    few = Few.of(table["key"].to_numpy().view(np.uint64), record, table["pos"].to_numpy(), np.ones(len(record), np.int64))
    told = Setting(few if with_bases else few.counted(), keys.value, often, strand, seq, records["g_off"].to_numpy(), records["len"].to_numpy())
    if with_bases:
        own = [d.encode() for d in records["dna"].to_pylist()]
        told.bases, told.begin = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0] + [len(d) for d in own[:-1]])
    return x.sparkSession.sparkContext.broadcast(told)


def _words(bases: np.ndarray, own: Setting, k: int, mask: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and keys of a record's words that may meet others."""
    for a in range(0, max(len(bases) - WORD + 1, 0), SLICE):
        starts, codes = pack_words(bases[a : a + SLICE + WORD - 1], mask)
        keys = codes >> np.uint64(2 * (WORD - k))
        kept = passes(own.filter, keys)
        if len(own.often):
            kept &= own.often[np.minimum(np.searchsorted(own.often, codes), len(own.often) - 1)] != codes
        yield starts[kept] + a, keys[kept]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for dna, seq, off in zip(batch.column("dna").cast(pa.binary()), batch.column("seq").to_pylist(), batch.column("g_off").to_pylist(), strict=True):
            yield seq, off, np.frombuffer(dna.as_buffer(), np.uint8) if dna.is_valid else np.empty(0, np.uint8)


def _batched(made: Iterator[dict[str, pa.Array]], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for own in made:
        held.append(pa.record_batch(own))
        n += held[-1].num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hit_counts(x: DataFrame, strands: dict[str, DataFrame], k: int, fl: int = 1000, mask: str = "skip") -> DataFrame | None:
    """strand, seqX, seqY, n: hits of each two records that have any; None where setting is."""
    told = setting(x, strands, k, fl, mask, with_bases=False)
    if told is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        names = pa.array(own.strand, pa.string())

        def made() -> Iterator[dict[str, pa.Array]]:
            for seq, _, bases in _records(batches):
                sums = np.zeros(len(own.seq), np.int64)
                for _, keys in _words(bases, own, k, mask):
                    keys, times = np.unique(keys, return_counts=True)
                    row, place = own.few.met(keys)
                    np.add.at(sums, own.few.record[place], times[row] * own.few.n[place])
                at = np.flatnonzero(sums)
                if len(at):
                    yield {"strand": names.take(pa.array(at)), "seqX": pa.array(np.full(len(at), seq)), "seqY": pa.array(own.seq[at]), "n": pa.array(sums[at])}

        return _batched(made())

    return x.select("dna", "seq", "g_off").mapInArrow(run, COUNTS)


def went(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goes along x from px and y from py, n bases at most, with a score from `start`, until it falls below zero: the best score, its steps and
    matches, of all rows at once."""
    best, steps, matches = start.copy(), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    now, seen, at = start.copy(), np.zeros(len(n), np.int64), 0
    unknown = bool((x == N).any() or (y == N).any())
    pad = np.zeros(WIDEST, np.uint8)
    x, y = np.concatenate([x, pad]), np.concatenate([y, pad])
    active, wide = np.flatnonzero(n > 0), FIRST
    while len(active):
        left, seen_x, seen_y, cols = [], np.lib.stride_tricks.sliding_window_view(x, wide), np.lib.stride_tricks.sliding_window_view(y, wide), np.arange(wide)
        for low in range(0, len(active), CELLS // wide):
            own = active[low : low + CELLS // wide]
            a, b = seen_x[px[own] + at], seen_y[py[own] + at]
            same = a == b
            if unknown:
                no = (a == N) | (b == N)
                same &= ~no
                points = np.where(no, np.int8(UNKNOWN), np.where(same, np.int8(MATCH), np.int8(-MATCH)))
            else:
                points = same.view(np.int8) * np.int8(2 * MATCH) - np.int8(MATCH)
            sums = np.cumsum(points, axis=1, dtype=np.int32)
            over = now[own]
            below = sums < -over[:, None].astype(np.int32)
            reach = np.minimum(np.where(below.any(1), below.argmax(1), wide), n[own] - at)
            sums[cols >= reach[:, None]] = np.iinfo(np.int32).min
            k = sums.argmax(1)
            rows = np.arange(len(own))
            top = over + sums[rows, k]
            better = np.flatnonzero((reach > 0) & (top > best[own]))
            to = own[better]
            best[to], steps[to] = top[better], at + k[better] + 1
            matches[to] = seen[to] + (same[better] & (cols <= k[better, None])).sum(1)
            on = np.flatnonzero((reach == wide) & (n[own] - at > wide))
            now[own[on]] += sums[on, -1]
            seen[own[on]] += same[on].sum(1)
            left.append(own[on])
        active, at, wide = np.concatenate(left), at + wide, min(wide * 2, WIDEST)
    return best, steps, matches


def _thinned(p: np.ndarray, q: np.ndarray, record: np.ndarray, k: int) -> np.ndarray:
    """The rows of one record's hits that thinning keeps, by record of Y and diagonal."""
    order = np.lexsort((p, p - q, record))
    firsts = run_starts(record[order], (p - q)[order])
    return order[walked(p[order], np.full(len(p), 2 * k), firsts, np.full(len(firsts), NOWHERE))]


def accepted(x: DataFrame, strands: dict[str, DataFrame], k: int, fl: int, lmin: int, simthr: float, mask: str = "skip") -> DataFrame | None:
    """Of all thinned hits the fragments that are longer than lmin and more similar than simthr: the rows of extend that judged accepts; None
    where setting is."""
    told = setting(x, strands, k, fl, mask, with_bases=True)
    if told is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        turned, names, end = own.bases[::-1].copy(), pa.array(own.strand, pa.string()), len(own.bases)

        def extended(seq: int, off: int, bases: np.ndarray, p: np.ndarray, record: np.ndarray, q: np.ndarray) -> dict[str, pa.Array]:
            kept = _thinned(p, q, record, k)
            p, record, q = p[kept], record[kept], q[kept]
            begin = own.begin[record]
            ahead = np.minimum(len(bases) - p, own.length[record] - q) - k
            best, right, more = went(bases, own.bases, p + k, begin + q + k, ahead, np.full(len(p), MATCH * k))
            best, steps, matches = went(bases[::-1], turned, len(bases) - p, end - begin - q, np.minimum(p, q), best)
            last = np.where(right > 0, right + k - 1, k)
            length = last + steps + 1
            similarity = (best * 100.0 / (length * MATCH)).astype(np.float32)
            to = np.flatnonzero((length > lmin) & (similarity > np.float32(simthr)))
            posX, posY, seqY = p[to] + off, q[to] + own.off[record[to]], own.seq[record[to]]
            s, e = steps[to], last[to]
            numbers = {"diag": posX - posY, "posX": posX, "posY": posY, "seqX": np.full(len(to), seq), "seqY": seqY, "xStart": posX - s - seq, "yStart": posY - s - seqY}
            numbers |= {"xEnd": posX + e - seq, "yEnd": posY + e - seqY, "length": length[to], "ident": (matches + more)[to] + k, "score": best[to]}
            return {"strand": names.take(pa.array(record[to]))} | {c: pa.array(v, pa.int64()) for c, v in numbers.items()} | {"similarity": pa.array(similarity[to])}

        def made() -> Iterator[dict[str, pa.Array]]:
            for seq, off, bases in _records(batches):
                found = list(_words(bases, own, k, mask))
                if not found:
                    continue
                starts, keys = (np.concatenate(c) for c in zip(*found, strict=True))
                for few in _ranges(own.few, keys, len(own.seq)):
                    row, place = few.met(keys)
                    if len(row):
                        record = few.record[place]
                        yield extended(seq, off, bases, starts[row], record, few.pos[place] - own.off[record])

        return _batched(made())

    return x.select("dna", "seq", "g_off").mapInArrow(run, EXTENDED)


def _ranges(few: Few, keys: np.ndarray, n_records: int) -> Iterator[Few]:
    """The words of Y, or, if a record of X has very many hits, those of some records of Y after another."""
    at = np.minimum(np.searchsorted(few.keys, keys), len(few.keys) - 1) if len(few.keys) else np.empty(0, np.int64)
    times = np.bincount(at[few.keys[at] == keys[: len(at)]], minlength=len(few.keys))
    if int((times * np.diff(few.begin)).sum()) <= HITS:
        yield few
        return
    hits = np.bincount(few.record, np.repeat(times, np.diff(few.begin)), n_records)
    upto, low = np.cumsum(hits), 0
    while low < n_records:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + HITS, "right")))
        yield few.within(low, high)
        low = high
