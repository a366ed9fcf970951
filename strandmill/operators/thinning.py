"""Greedy thinning of hits along diagonals, and the skip of seeds that a fragment covers.

Both walk along a diagonal: a row that is used says how far its leap goes, and the next one used is the first at or behind
that place. So each row has one successor, found by binary search, and the used rows are those that the first one
reaches, found by doubling the jumps. Diagonals go to tasks, sorted; a batch of rows is solved at once, whatever
the number of its diagonals, with one number handed on to the next batch.

A diagonal with very many rows is cut into ranges of places. What happens in a range depends only on where the leap of the last
row used before it ends, so each range is first made into a function from that place to the one where the range itself leaves the
walk; these functions, a row for each range, are chained, and then each range is walked from its own entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.storage import saved, small

HIT = "strand string, diag bigint, posX bigint, posY bigint, seqX bigint, seqY bigint"
#: Rows of a diagonal from which it is cut, and places of a range.
HOT, SPAN = 1 << 20, 1 << 18
#: Smaller than any place: no leap so far.
NOWHERE = np.iinfo(np.int64).min


def reached(jumps: np.ndarray, first: int) -> np.ndarray:
    """Whether each of n rows is reached from the first one; jumps gives each row's successor, n if it has none."""
    n = len(jumps)
    levels, jump = [], np.append(jumps, n)
    while (jump[:n] < n).any():
        levels.append(jump)
        jump = jump[jump]
    hit = np.zeros(n + 1, bool)
    hit[first] = True
    for level in reversed(levels):
        hit[level[np.flatnonzero(hit)]] = True
    return hit[:n]


def ends(places: np.ndarray, leaps: np.ndarray) -> np.ndarray:
    """Where the leap of each row ends; NOWHERE for one that has none (0)."""
    return np.where(leaps > 0, places + leaps, NOWHERE)


def walked(places: np.ndarray, leaps: np.ndarray, firsts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which rows are used. firsts: where each diagonal begins among the rows, which are sorted on each; entries:
    the place of each diagonal before which no row is used."""
    n, low = len(places), places.min()
    wide = places.max() - low + 2  # diagonals are laid one behind the other, so that one search does for all
    lengths = np.diff(np.append(firsts, n))
    shift = np.repeat(np.arange(len(firsts)) * wide, lengths)
    at = places - low + shift
    jumps = np.where(leaps > 0, np.searchsorted(at, np.minimum(places - low + leaps, wide - 1) + shift), np.arange(n) + 1)
    begin = np.searchsorted(at, np.clip(entries, low, low + wide - 1) - low + np.arange(len(firsts)) * wide)
    behind = firsts + lengths
    begin = np.minimum.accumulate(np.where(begin < behind, begin, n)[::-1])[::-1]  # where a diagonal has none, the next one's
    leaves = jumps >= np.repeat(behind, lengths)
    jumps = np.where(leaves, np.repeat(np.append(begin[1:], n), lengths), jumps)
    return reached(jumps, int(begin[0]))


def range_function(places: np.ndarray, leaps: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """The range as a step function: an entry up to uppers[i], but above uppers[i - 1], leaves it at outs[i]; NOWHERE, or an entry
    behind all of uppers: it is not changed. Entries lie at most `deepest` behind the range's first row."""
    n = len(places)
    jump = np.append(np.where(leaps > 0, np.searchsorted(places, places + leaps), np.arange(n) + 1), n)
    out = np.append(ends(places, leaps), NOWHERE)
    while (jump[:n] < n).any():
        out, jump = np.maximum(out, out[jump]), jump[jump]  # ends rise along a walk
    needed = min(n, int(np.searchsorted(places, places[0] + deepest)) + 1)
    uppers, out = places[:needed], out[:needed]
    last = np.append(out[1:] != out[:-1], True)
    return uppers[last], out[last]


def boundaries(batch: pa.RecordBatch, groups: list[str]) -> np.ndarray:
    """Rows at which another group than the row's before begins; the first one too."""
    change = np.zeros(batch.num_rows - 1, bool)
    for c in groups:
        column = batch.column(c)
        column = (column.dictionary_encode().indices if pa.types.is_string(column.type) else column).to_numpy()
        change |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def key_at(batch: pa.RecordBatch, groups: list[str], i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in groups)


def _walk(groups: list[str], keep: list[str], entry: str | None = None):
    """Batches of rows sorted by groups and posX (the columns of keep) to those rows that are used; entry: column of each
    group's entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, end = None, NOWHERE
        for batch in batches:
            if not batch.num_rows:
                continue
            places, leaps = batch.column("posX").to_numpy(), batch.column("__leap").to_numpy()
            firsts = boundaries(batch, groups)
            entries = batch.column(entry).to_numpy()[firsts].copy() if entry else np.full(len(firsts), NOWHERE)
            if key_at(batch, groups, 0) == group:
                entries[0] = end
            used = walked(places, leaps, firsts, entries)
            last = int(firsts[-1])
            end = max(int(entries[-1]), int(ends(places[last:], leaps[last:])[used[last:]].max(initial=NOWHERE)))
            group = key_at(batch, groups, batch.num_rows - 1)
            yield batch.select(keep).take(pa.array(np.flatnonzero(used)))

    return run


def _functions(groups: list[str], schema: pa.Schema):
    """Batches of rows sorted by groups, range and posX to the function of each range."""

    def made(key: tuple, parts: list[tuple[np.ndarray, np.ndarray]], deepest: int) -> pa.RecordBatch:
        uppers, outs = range_function(*(np.concatenate(c) for c in zip(*parts, strict=True)), deepest)
        return pa.record_batch([pa.array([v], t) for v, t in zip((*key, uppers, outs), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [*groups, "__range"]
        key, parts, deepest = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places, leaps, firsts = batch.column("posX").to_numpy(), batch.column("__leap").to_numpy(), boundaries(batch, by)
            for a, b in zip(firsts, [*firsts[1:], batch.num_rows], strict=True):
                own = key_at(batch, by, int(a))
                if own != key and parts:
                    yield made(key, parts, deepest)
                    parts = []
                key, deepest = own, batch.column("__deepest")[int(a)].as_py()
                parts.append((places[a:b], leaps[a:b]))
        if parts:
            yield made(key, parts, deepest)

    return run


def _entries(groups: list[str], schema: pa.Schema):
    """Functions of ranges, sorted by groups and range, to each range's entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = None, NOWHERE
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own = key_at(batch, groups, i)
                if own != group:
                    group, at = own, NOWHERE
                out.append(at)
                uppers, outs = (batch.column(c)[i].values.to_numpy() for c in ("__uppers", "__outs"))
                k = int(np.searchsorted(uppers, at))
                if k < len(uppers) and outs[k] != NOWHERE:
                    at = int(outs[k])
            columns = [*(batch.column(c) for c in [*groups, "__range"]), pa.array(out, pa.int64())]
            yield pa.record_batch(columns, schema=schema)

    return run


def used_rows(rows: DataFrame, groups: list[str], leap: Column) -> DataFrame:
    """Of each group the rows that are used, in order of posX: the first one, and each that doesn't lie before the end of a used
    row's leap (posX and so many places; null or 0: it bars none). rows are read up to four times: pass a written table.
    No group has two rows of one posX in a range that is cut; elsewhere such rows stay in any order."""
    kept = rows.columns
    rows = rows.withColumn("__leap", F.coalesce(leap.cast("bigint"), F.lit(0).cast("bigint")))
    hot = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.max("__leap").alias("__deepest")).filter(F.col("__n") > HOT).drop("__n")

    def by_group(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition(*groups, *more).sortWithinPartitions(*groups, *more, "posX")

    if not hot.limit(1).count():
        return by_group(rows).mapInArrow(_walk(groups, kept), rows.select(*kept).schema)
    hot = small(saved(hot, "hot-diagonals"))  # one for each HOT rows at most
    cold = by_group(rows.join(hot, groups, "left_anti")).mapInArrow(_walk(groups, kept), rows.select(*kept).schema)
    cut = rows.join(hot, groups).withColumn("__range", F.floor(F.col("posX") / SPAN))
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in groups) + ", __range bigint"
    of = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}

    def arrow(schema: str) -> pa.Schema:
        return pa.schema([(n, of[t]) for n, t in (c.split() for c in schema.split(", "))])

    functions, entries = f"{keys}, __uppers array<bigint>, __outs array<bigint>", f"{keys}, __entry bigint"
    made = by_group(cut, "__range").select(*groups, "__range", "posX", "__leap", "__deepest").mapInArrow(_functions(groups, arrow(functions)), functions)
    chained = made.repartition(*groups).sortWithinPartitions(*groups, "__range").mapInArrow(_entries(groups, arrow(entries)), entries)
    entered = cut.drop("__deepest").join(saved(chained, "entries"), [*groups, "__range"])
    ranges = by_group(entered, "__range").mapInArrow(_walk([*groups, "__range"], kept, "__entry"), rows.select(*kept).schema)
    return cold.unionByName(ranges)


def thin(hits: DataFrame, k: int = 32, by: tuple[str, ...] = ()) -> DataFrame:
    """Keeps a hit if it is the first of its (strand, diag, seqX, seqY) by posX, or lies over 2k - 1
    behind the last kept one of them. by: further string columns that tell hits apart (genomes)."""
    groups = [*by, "strand", "diag", "seqX", "seqY"]
    return used_rows(hits.select(*by, "strand", "diag", "posX", "posY", "seqX", "seqY"), groups, F.lit(2 * k))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs to hits, SPAN at a time."""
    for batch in batches:
        n, names = batch.column("n").to_numpy(), [c for c in batch.schema.names if c != "n"]
        upto = np.cumsum(n)
        for low in range(0, int(upto[-1]) if len(n) else 0, SPAN):
            at = np.arange(low, min(low + SPAN, int(upto[-1])))
            of = np.searchsorted(upto, at, "right")
            out = batch.select(names).take(pa.array(of))
            step = pa.array(at - (upto - n)[of])
            yield pa.RecordBatch.from_arrays([pc.add(out.column(c), step) if c in ("posX", "posY") else out.column(c) for c in names], names)


def single_hits(runs: DataFrame) -> DataFrame:
    kept = [c for c in runs.columns if c != "n"]
    return runs.select(*kept, "n").mapInArrow(_single, runs.select(*kept).schema)


def thin_runs(runs: DataFrame, k: int = 32, by: tuple[str, ...] = ()) -> DataFrame:
    """thin of hits that come in runs (a hit, and n, how many follow each other on its diagonal, itself included), which are made into
    single ones only where a diagonal is walked along. No two runs hold the same hit, so their order is that of their hits. runs are
    read several times: pass a written table."""
    groups = [*by, "strand", "diag", "seqX", "seqY"]
    kept = [*by, "strand", "diag", "posX", "posY", "seqX", "seqY"]
    rows, walk = runs.select(*kept, "n"), _walk(groups, kept)

    def walked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return walk(b.append_column("__leap", pa.array(np.full(b.num_rows, 2 * k))) for b in _single(batches))

    def cold(df: DataFrame) -> DataFrame:
        return df.repartition(*groups).sortWithinPartitions(*groups, "posX").select(*kept, "n").mapInArrow(walked_runs, rows.select(*kept).schema)

    hot = saved(rows.groupBy(*groups).agg(F.sum("n").alias("__n")).filter(F.col("__n") > HOT).drop("__n"), "hot-diagonals")
    if not hot.limit(1).count():
        return cold(rows)
    few = small(hot)  # one for each HOT hits at most
    return cold(rows.join(few, groups, "left_anti")).unionByName(thin(single_hits(rows.join(few, groups)), k, by))


def skip_covered(extended: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Keeps the seeds that are used: in order of posX on a diagonal (whatever the sequences), a seed is
    skipped if it lies before the end of the last accepted fragment, counted as that one's seed place plus
    its length. extended has strand, diag, posX, length, accepted, and the columns of by."""
    return used_rows(extended, [*by, "strand", "diag"], F.when(F.col("accepted"), F.col("length")))
