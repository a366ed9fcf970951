"""Words with their places in cells, which are stored as they travel: in runs of neighbours, two bits a base.

A cell has the words whose minimiser, that of their first k letters, falls into it, so equal keys of two genomes lie in cells of one number. It is one row, with all places
of each of its words; how often a word comes is counted where the row is read. A cell of over LARGE words is written in several rows, and none of them is `whole`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.keyfilter import passes
from strandmill.operators.kmers import WORD
from strandmill.operators.placed import coded, decoded, placed_runs, run_starts, within
from strandmill.operators.superwords import stretched, unpacked

#: Cells of a store; words of a cell that is one row.
CELLS, LARGE = 1 << 14, 1 << 22
#: Words whose runs a task deals out at a time; words that are cut from runs, and hits that are made, at a time; bytes of rows handed over together, and of
#: those that are compressed together, about.
DEALT, CUT, HITS, BYTES, ZIPPED = 1 << 23, 1 << 18, 1 << 19, 1 << 23, 1 << 24
RUNS = ("lengths", "bases", "seqs", "places")
CELL = "key bigint, whole boolean, n bigint, " + ", ".join(f"{c} binary" for c in RUNS)
WORDS = "key bigint, code bigint, seq bigint, pos bigint, num bigint"
HIT = "strand string, diag bigint, posX bigint, posY bigint, seqX bigint, seqY bigint"


def in_cells(sequences: DataFrame, cells: int, buckets: int, k: int = WORD, mask: str = "skip") -> DataFrame:
    """CELL, dealt to buckets by key, the number of the cell. sequences: dna, seq and g_off."""
    rows = placed_runs(sequences.withColumn("group", F.lit(0).cast("bigint")), cells, k, mask, DEALT).select(F.col("bucket").alias("key"), "n", *RUNS)
    spread = sequences.sparkSession.range(cells).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).orderBy("id").collect()  # a row for each cell
    _, first, of = np.unique([r["bucket"] for r in spread], return_index=True, return_inverse=True)
    packed = rows.mapInArrow(_zipped(first[of]), "key bigint, rows binary")
    dealt = packed.repartition(buckets, "key").mapInArrow(_unzipped, "key bigint, n bigint, " + ", ".join(f"{c} binary" for c in RUNS))
    return dealt.sortWithinPartitions("key").mapInArrow(_gathered(LARGE), CELL)


def _zipped(leader: np.ndarray):
    """Rows whose cells have one leader, the first cell of their bucket, as one row under its key: together they can be compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            rows = pa.concat_batches(held)
            held, n_held = [], 0
            first = leader[rows.column("key").to_numpy()]
            order = np.argsort(first, kind="stable")
            cuts = np.append(run_starts(first[order]), len(order))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, sink = rows.take(pa.array(order[a:b])), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(own)
                yield pa.record_batch({"key": pa.array(first[order[a : a + 1]], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            held.append(batch)
            n_held += batch.nbytes
            if n_held >= ZIPPED:
                yield from told()
        if held:
            yield from told()

    return run


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column("rows"):
            yield from pa.ipc.open_stream(rows.as_buffer())


def _gathered(large: int):
    """Rows of runs, sorted by cell, to rows of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, cut = None, [], 0, False
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            nonlocal out
            own, out = out, []
            types = [pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * len(RUNS)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*own, strict=True), types, strict=True)], [c.split()[0] for c in CELL.split(", ")])

        n_out = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", *RUNS)), strict=True):
                same = row[0] == key
                if held and (not same or n + row[1] > large):
                    out.append((key, not (same or cut) and n <= large, n, *_joined(held)))
                    n_out += sum(map(len, out[-1][3:]))
                    held, n, cut = [], 0, same
                    if n_out >= BYTES:
                        yield told()
                        n_out = 0
                key, n = row[0], n + row[1]
                held.append(row[2:])
        if held:
            out.append((key, not cut and n <= large, n, *_joined(held)))
        if out:
            yield told()

    return run


def _joined(rows: list[tuple]) -> tuple[bytes, ...]:
    """RUNS of one row, by place, from those of some."""
    lengths = np.concatenate([np.frombuffer(r[0], np.uint8) for r in rows])
    bases = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
    seqs, places = (np.concatenate([decoded(r[i], len(r[0])) for r in rows]) for i in (2, 3))
    order = np.argsort(places, kind="stable")
    n_bytes = _held(lengths)
    bases = bases[stretched((np.cumsum(n_bytes) - n_bytes)[order], n_bytes[order])]
    return lengths[order].tobytes(), bases.tobytes(), coded(seqs[order]), coded(places[order])


def _held(lengths: np.ndarray) -> np.ndarray:
    """Bytes of the bases of runs."""
    return -(-(lengths.astype(np.int64) + WORD - 1) // 4)


def _words(row: dict, side: str = "", chosen: Callable | None = None) -> tuple[np.ndarray, ...]:
    """code, seq and place of the words of a row, or of those that chosen (codes to a mask) takes; only they are held."""
    lengths, bases = (np.frombuffer(row[c + side], np.uint8) for c in RUNS[:2])
    seqs, places = (decoded(row[c + side], len(lengths)) for c in RUNS[2:])
    size, at = lengths.astype(np.int64), np.append(0, np.cumsum(_held(lengths)))
    out = []
    for a, b in within(np.cumsum(size), CUT):
        code = unpacked(lengths[a:b], bases[at[a] : at[b]])
        kept = np.flatnonzero(chosen(code)) if chosen else np.arange(len(code))
        ends = np.cumsum(size[a:b])
        of = np.searchsorted(ends, kept, "right")
        out.append((code[kept], seqs[a + of], places[a + of] + kept - (ends - size[a:b])[of]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _few(words: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    """The words with at most so many places, by code, with their number."""
    order = np.argsort(words[0], kind="stable")
    words = tuple(c[order] for c in words)
    starts = run_starts(words[0])
    num = np.diff(np.append(starts, len(order)))
    num = np.repeat(num, num)
    kept = num <= most
    return tuple(c[kept] for c in (*words, num))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def words_in_cells(rows: DataFrame, k: int, most: int | None = None, keys: Broadcast | None = None) -> DataFrame:
    """WORDS of rows of cells. most: those with at most so many places in their row; keys: a filter, of those that pass."""
    shift = np.uint64(2 * (WORD - k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = _words(row, chosen=(lambda code: passes(keys.value, code >> shift)) if keys else None)
            code, seq, place, num = _few(words, most) if most is not None else (*words, np.zeros(len(words[0]), np.int64))
            for a in range(0, len(code), CUT):
                own = slice(a, a + CUT)
                columns = ((code[own] >> shift).view(np.int64), code[own].view(np.int64), seq[own], place[own], num[own])
                yield pa.record_batch([pa.array(c) for c in columns], [c.split()[0] for c in WORDS.split(", ")])

    return rows.select(*RUNS).mapInArrow(run, WORDS)


def often_in_cells(rows: DataFrame, most: int) -> DataFrame:
    """code: words of which there may be over `most` places. rows: of cells, and pieces, the number of rows that the cell has; a word with over
    `most` places has in one of them more than that row's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            code, n = np.unique(_words(row)[0], return_counts=True)
            yield pa.record_batch({"code": pa.array(code[n * row["pieces"] > most].view(np.int64))})

    return rows.select("pieces", *RUNS).mapInArrow(run, "code bigint").distinct()


def hits_in_cells(x: DataFrame, y: DataFrame, strand: str, k: int, most: int) -> DataFrame:
    """HIT of the whole cells of two genomes, from words with at most so many places on either side. They are joined where they lie."""
    shift = np.uint64(2 * (WORD - k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yc, ys, yp, _ = _few(_words(row, "_y"), most)
            yk = yc >> shift  # sorted, as codes are
            first = run_starts(yk)
            if not len(first):
                continue
            keys, begin = yk[first], np.append(first, len(yk))

            def met(code: np.ndarray, keys: np.ndarray = keys) -> np.ndarray:
                key = code >> shift
                return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key

            xc, xs, xp, _ = _few(_words(row, "_x", met), most)
            at = np.searchsorted(keys, xc >> shift)
            n = begin[at + 1] - begin[at]
            for a, b in within(np.cumsum(n), HITS):
                i, j = np.repeat(np.arange(a, b), n[a:b]), stretched(begin[at[a:b]], n[a:b])
                columns = {"diag": xp[i] - yp[j], "posX": xp[i], "posY": yp[j], "seqX": xs[i], "seqY": ys[j]}
                yield pa.record_batch({"strand": pa.array([strand] * len(i), pa.string())} | {c: pa.array(v) for c, v in columns.items()})

    left, right = (d.filter("whole").select("key", *[F.col(c).alias(c + side) for c in RUNS]) for d, side in ((x, "_x"), (y, "_y")))
    both = left.join(right.hint("merge"), "key").select(*[c + side for side in ("_x", "_y") for c in RUNS])
    return both.mapInArrow(run, HIT)
