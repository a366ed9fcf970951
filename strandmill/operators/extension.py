"""Ungapped extension of seeds in both directions while the score stays positive, over blocks of the sequences.

A seed is a state that walks: to the right first, and, when that has ended, to the left from the seed with the best score so far. In a
round each open state visits the two blocks in which its next bases lie, goes on up to their edge, and either ends there or
stays open. A state that passed a whole edge-to-edge stretch twice as far in the next round looks ahead: it visits so many
further stretches at once, each of which tells only its sum, its smallest and its greatest partial sum; these are added up in
order, up to the first stretch in which the score would fall below zero. So a fragment of n blocks takes some log n rounds, and
no row holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.sources.blocks import BlockedGenome
from strandmill.storage import BROADCAST_ROWS, saved

#: Points of a match (a mismatch loses as many), and of a pair with an unknown base.
MATCH, UNKNOWN = 4, -1
#: Bases compared first; each further step is twice as long.
STEP = 256
#: States that a task takes to one pair of blocks, about; more are dealt out, and the blocks copied.
PAIR_HITS = 20_000
#: What a state adds to its hit. phase: 0 to the right, 1 to the left, 2 ended; now: running score; best: the first one that exceeds
#: all before, at steps bases with matches among them; at, seen: bases so far and matches among them; right, more: steps and
#: matches of the right side, kept while the left one is walked.
STATE = ("phase", "now", "best", "steps", "matches", "at", "seen", "right", "more", "width")
#: What a stretch that is looked at ahead tells.
AHEAD = ("n", "total", "lowest", "highest", "highest_at", "highest_seen", "same")
EXTENDED = "strand string, diag bigint, posX bigint, posY bigint, seqX bigint, seqY bigint, xStart bigint, yStart bigint, xEnd bigint, yEnd bigint, length bigint, ident bigint, score bigint, similarity float"
_LETTERS = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGTUacgtu", b"TGCAAtgcaa", strict=True):  # as functions/dna.py has them
    _LETTERS[_a] = _b


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of each pair of bases, and whether they match."""
    unknown = (a == 78) | (b == 78)
    same = (a == b) & ~unknown
    return np.where(unknown, UNKNOWN, np.where(same, MATCH, -MATCH)), same


def walk(a: np.ndarray, b: np.ndarray, state: tuple[int, int, int, int, int, int]) -> tuple[bool, tuple[int, int, int, int, int, int]]:
    """Goes along two byte arrays of one length with (now, best, steps, matches, at, seen); returns whether the score fell below zero."""
    now, best, steps, matches, at, seen = state
    done, size = 0, STEP
    while done < len(a):
        points, same = compared(a[done : done + size], b[done : done + size])
        sums = now + np.cumsum(points)
        below = np.flatnonzero(sums < 0)
        reach = int(below[0]) if len(below) else len(points)
        if reach:
            k = int(np.argmax(sums[:reach]))
            if sums[k] > best:
                best, steps, matches = int(sums[k]), at + k + 1, seen + int(np.count_nonzero(same[: k + 1]))
        if len(below):
            return True, (now, best, steps, matches, at, seen)
        now, seen, at = int(sums[-1]), seen + int(np.count_nonzero(same)), at + len(points)
        done, size = done + len(points), size * 2
    return False, (now, best, steps, matches, at, seen)


def stretch(a: np.ndarray, b: np.ndarray) -> tuple[int, ...]:
    """AHEAD of two byte arrays of one length."""
    if not len(a):
        return 0, 0, 0, 0, 0, 0, 0
    points, same = compared(a, b)
    sums = np.cumsum(points)
    k = int(np.argmax(sums))
    return len(a), int(sums[-1]), int(sums.min()), int(sums[k]), k + 1, int(np.count_nonzero(same[: k + 1])), int(np.count_nonzero(same))


def passed(state: tuple[int, int, int, int, int, int], ahead: tuple[int, ...]) -> tuple[int, int, int, int, int, int] | None:
    """The state behind a stretch, as walk would leave it; None if the score falls below zero in it."""
    now, best, steps, matches, at, seen = state
    n, total, lowest, highest, highest_at, highest_seen, same = ahead
    if n and now + lowest < 0:
        return None
    if n and now + highest > best:
        best, steps, matches = now + highest, at + highest_at, seen + highest_seen
    return now + total, best, steps, matches, at + n, seen + same


class Side:
    """A block of one sequence and its place in the record, in the strand's own coordinates."""

    def __init__(self, bases: str, begin: int, turned: bool, length: int):
        own = np.frombuffer(bases.encode(), np.uint8)
        self.bases, self.begin = (_LETTERS[own[::-1]], length - begin - len(own)) if turned else (own, begin)
        self.end = self.begin + len(own)

    def right(self, at: int, n: int) -> np.ndarray:
        return self.bases[at - self.begin : at - self.begin + n]

    def left(self, at: int, n: int) -> np.ndarray:
        """n bases from at downwards."""
        i = at - self.begin
        return self.bases[i - n + 1 : i + 1][::-1]


def _visit(keep: list[str], text: list[str], k: int, size: int, schema: pa.Schema):
    """Rows of one pair of blocks after another, the blocks first, then the states that visit them; to states, and stretches."""

    def one(x: Side, y: Side, r: dict) -> tuple:
        p, q, phase = r["p"], r["q"], r["phase"]
        state = tuple(r[c] for c in STATE[1:7])
        right, more = r["right"], r["more"]
        if phase == 0:
            px, py = p + k + state[4], q + k + state[4]
            total = min(r["x_len"] - px, r["y_len"] - py)
            n = max(0, min(x.end - px, y.end - py, total))
            fell, state = walk(x.right(px, n), y.right(py, n), state)
            if not fell and n < total:
                return 0, *state, right, more
            right, more = state[2], state[3]
            phase, state = 1, (state[1], state[1], 0, 0, 0, 0)
        px, py = p - 1 - state[4], q - 1 - state[4]
        total = min(px, py) + 1
        if total > 0 and not (x.begin <= px < x.end and y.begin <= py < y.end):
            return 1, *state, right, more
        n = max(0, min(px - x.begin, py - y.begin, total - 1) + 1) if total > 0 else 0
        fell, state = walk(x.left(px, n), y.left(py, n), state) if n else (False, state)
        return (1 if not fell and n < total else 2), *state, right, more

    def ahead(x: Side, y: Side, r: dict) -> tuple[int, ...]:
        px, py, n = r["px"], r["py"], r["span"]
        return stretch(x.right(px, n), y.right(py, n)) if r["phase"] == 0 else stretch(x.left(px, n), y.left(py, n))

    numbers = [c for c in (*keep, "j", "p", "q", "px", "py", "span", "x_len", "y_len", *STATE) if c not in text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = y = None
        for batch in batches:
            is_x, is_y = (batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in "xy")
            columns = {c: batch.column(c).to_pylist() for c in (*numbers, *text, "y_turned", "bx", "by")}
            bases = {c: batch.column(c) for c in "xy"}
            out = []
            for i in range(batch.num_rows):
                if is_x[i]:
                    x = Side(bases["x"][i].as_py(), columns["bx"][i] * size, False, 0)
                    continue
                if is_y[i]:
                    y = Side(bases["y"][i].as_py(), columns["by"][i] * size, columns["y_turned"][i], columns["y_len"][i])
                    continue
                r = {c: columns[c][i] for c in numbers}
                if r["j"]:
                    new, told = tuple(r[c] for c in STATE), ahead(x, y, r)
                else:
                    new, told = (*one(x, y, r), r["width"]), (None,) * len(AHEAD)
                out.append((*[columns[c][i] for c in keep], r["j"], r["p"], r["q"], r["x_len"], r["y_len"], *new, *told))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(schema), schema.types, strict=True)], schema=schema)

    return run


def _fold(names: list[str], schema: pa.Schema):
    """Rows sorted by (id, j): a state and the stretches ahead of it, to the state behind those that it passes."""
    at = [names.index(c) for c in STATE]
    told = [schema.names.index(c) for c in AHEAD]
    j, phase, width = schema.names.index("j"), names.index("phase"), names.index("width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_, before = None, False, None

        def ended(row: list) -> list:
            row[width] = row[width] * 2 if open_ else 1
            return row

        def result(rows: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), [schema.field(n).type for n in names], strict=True)], names=names)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[j] == 0:
                    if own is not None:
                        out.append(ended(own))
                    # A state that has turned or ended looks no further.
                    own, before = [row[schema.names.index(n)] for n in names], row
                    open_ = row[schema.names.index("walked")] == row[schema.names.index("phase")]
                elif open_:
                    new = passed(tuple(own[i] for i in at[1:7]), tuple(row[i] for i in told))
                    if new is None:
                        open_ = False
                    else:
                        for i, v in zip(at[1:7], new, strict=True):
                            own[i] = v
            yield result(out)
        if own is not None:
            yield result([ended(own)])

    return run


def _frontier(size: int, k: int) -> dict[str, Column]:
    """Of a state: px, py, the next bases to be compared; left_x, left_y: bases up to the edge of their blocks; total: up to a record's end."""
    right = F.col("phase") == 0
    step = F.col("at")
    px, py = (F.when(right, F.col(c) + k + step).otherwise(F.col(c) - 1 - step) for c in "pq")
    return {"px": px, "py": py, "total": F.when(right, F.least(F.col("x_len") - px, F.col("y_len") - py)).otherwise(F.least(px, py) + 1)}


def _with_block(df: DataFrame, size: int) -> DataFrame:
    """bx and by, the blocks in which px and py lie; of y as it is stored."""
    stored = F.when(F.col("y_turned"), F.col("y_len") - 1 - F.col("py")).otherwise(F.col("py"))
    return df.withColumns({"bx": F.floor(F.col("px") / size), "by": F.floor(stored / size)})


def _stretches(states: DataFrame, size: int) -> DataFrame:
    """A row for each stretch j (0: where the state is) that a state visits: px, py and span of each."""
    right, turned = F.col("phase") == 0, F.col("y_turned")
    stored = F.when(turned, F.col("y_len") - 1 - F.col("py")).otherwise(F.col("py"))
    # bases up to the edge of a block, going up or down in it
    left_x = F.when(right, size - F.pmod(F.col("px"), F.lit(size))).otherwise(F.pmod(F.col("px"), F.lit(size)) + 1)
    left_y = F.when(right != turned, size - F.pmod(stored, F.lit(size))).otherwise(F.pmod(stored, F.lit(size)) + 1)
    near, far = F.least(left_x, left_y), F.greatest(left_x, left_y)
    rows = states.withColumns({"near": near, "far": far}).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("width") - 1, F.lit(0)).cast("bigint"))))

    def begin(j: Column) -> Column:
        odd = F.pmod(j, F.lit(2)) == 1
        return F.when(j == 0, 0).when(odd, F.col("near") + F.floor((j - 1) / 2) * size).otherwise(F.col("far") + (F.floor(j / 2) - 1) * size)

    rows = rows.withColumns({"from": begin(F.col("j")), "to": F.least(begin(F.col("j") + 1), F.col("total"))})
    sign = F.when(F.col("phase") == 0, 1).otherwise(-1)
    rows = rows.filter("j = 0 OR from < to").withColumn("span", F.col("to") - F.col("from"))
    return rows.withColumns({"px": F.col("px") + sign * F.col("from"), "py": F.col("py") + sign * F.col("from")}).drop("near", "far", "from", "to")


def extend(hits: DataFrame, x: BlockedGenome, y: BlockedGenome, k: int = 32) -> DataFrame:
    """One row for each hit: the hit, and the fragment in coordinates without separators. seqY stays that of its strand's own
    order. Of collections, hits have genome_x and genome_y. The result is written.

    Each pair of blocks that states visit travels once a round, to as many tasks as its states call for.
    """
    size = x.size
    if y.size != size:
        raise ValueError("both genomes must have blocks of one size")
    of_x, of_y = (["genome_x"], ["genome_y"]) if x.keys else ([], [])
    genome_names = [*of_x, *of_y]
    keep = ["id", *genome_names, "strand", "diag", "posX", "posY", "seqX", "seqY", "ofY", "y_turned"]
    text = [*genome_names, "strand", "y_turned"]

    def named_x(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"genome": "genome_x", "seq": "seqX"})

    def named_y(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"genome": "genome_y"})

    of_records_x = named_x(x.strand("f").select(*x.keys, "seq", F.col("len").alias("x_len"), F.col("g_off").alias("x_off")))
    strands = [y.strand(s).withColumn("strand", F.lit(s)) for s in "fr"]
    of_records_y = named_y(strands[0].unionByName(strands[1]).select(*y.keys, "strand", F.col("seq").alias("seqY"), F.col("of").alias("ofY"), F.col("len").alias("y_len"), F.col("g_off").alias("y_off")))
    states = hits.select(*genome_names, "strand", "diag", "posX", "posY", "seqX", "seqY").withColumn("id", F.monotonically_increasing_id())
    few_records = max(g.records.limit(BROADCAST_ROWS + 1).count() for g in ((x,) if x is y else (x, y))) <= BROADCAST_ROWS // 2

    def hinted(df: DataFrame, few: bool) -> DataFrame:
        return F.broadcast(df) if few else df

    states = states.join(hinted(of_records_x, few_records), [*of_x, "seqX"]).join(hinted(of_records_y, few_records), [*of_y, "strand", "seqY"])
    first = {"phase": 0, "now": MATCH * k, "best": MATCH * k, "steps": 0, "matches": 0, "at": 0, "seen": 0, "right": 0, "more": 0, "width": 1}
    states = states.withColumns({"p": F.col("posX") - F.col("x_off"), "q": F.col("posY") - F.col("y_off"), "y_turned": F.col("strand") == "r"} | {c: F.lit(v).cast("bigint") for c, v in first.items()})
    names = [*keep, "p", "q", "x_len", "y_len", *STATE]
    states = states.select(*names)
    types = {c: pa.string() for c in text} | {"y_turned": pa.bool_()}
    visit_names = [*keep, "j", "p", "q", "x_len", "y_len", *STATE, *AHEAD]
    schema = pa.schema([(c, types.get(c, pa.int64())) for c in visit_names])
    spark_schema = ", ".join(f"{c} {'boolean' if c == 'y_turned' else 'string' if c in text else 'bigint'}" for c in visit_names)

    cell = [*genome_names, "seqX", "bx", "ofY", "by", "y_turned"]
    blocks_x = named_x(x.blocks.select(*x.keys, "seq", F.col("block").alias("bx"), F.col("bases").alias("x")))
    blocks_y = named_y(y.blocks.select(*y.keys, F.col("seq").alias("ofY"), F.col("block").alias("by"), F.col("bases").alias("y")))
    lens = named_y(y.records.select(*y.keys, F.col("seq").alias("ofY"), F.col("len").alias("y_len")))
    done, open_ = None, states
    while True:
        at = open_.withColumns(_frontier(size, k))
        # At the end of a record a state visits its own last block; it has nothing to go along there.
        at = at.withColumns({"px": F.greatest(F.least("px", F.col("x_len") - 1), F.lit(0)), "py": F.greatest(F.least("py", F.col("y_len") - 1), F.lit(0))})
        visits = saved(_with_block(_stretches(at, size), size).drop("total"), "visits")
        cells = saved(visits.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PAIR_HITS).cast("bigint").alias("parts")), "cells")
        n_cells, n_heavy = cells.agg(F.count(F.lit(1)), F.count(F.when(F.col("parts") > 1, 1))).first()
        dealt = visits.withColumn("part", F.lit(0).cast("bigint"))
        if n_heavy:
            heavy = hinted(cells.filter("parts > 1"), n_heavy <= BROADCAST_ROWS)
            dealt = visits.join(heavy, cell, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0))).drop("parts")
        pairs = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        few_cells = n_cells <= BROADCAST_ROWS
        own_x = _needed(pairs, blocks_x, [*of_x, "seqX", "bx"], few_cells)
        own_y = _needed(pairs, blocks_y, [*of_y, "ofY", "by"], few_cells).join(hinted(lens, few_records), [*of_y, "ofY"])
        key = [*cell, "part"]
        rows = own_x.unionByName(own_y, allowMissingColumns=True).unionByName(dealt, allowMissingColumns=True)
        rows = rows.repartition(*key).sortWithinPartitions(*key, F.col("id").isNotNull())
        went = saved(rows.mapInArrow(_visit(keep, text, k, size, schema), spark_schema), "states")
        n_wide, n_open = went.agg(F.count(F.when(F.col("width") > 1, 1)), F.count(F.when((F.col("j") == 0) & (F.col("phase") < 2), 1))).first()
        after = _folded(went, open_, names, schema, bool(n_wide))
        ended = after.filter("phase = 2")
        done = ended if done is None else done.unionByName(ended)
        open_ = after.filter("phase < 2")
        if not n_open:
            break
    ahead = F.when(F.col("right") > 0, F.col("right") + k - 1).otherwise(F.lit(k))
    length = (ahead + F.col("steps") + 1).alias("length")
    score = F.col("best")
    similarity = (score * F.lit(100.0) / ((ahead + F.col("steps") + 1) * MATCH)).cast("float")
    return done.select(
        *genome_names, "strand", "diag", "posX", "posY", "seqX", "seqY",
        (F.col("posX") - F.col("steps") - F.col("seqX")).alias("xStart"), (F.col("posY") - F.col("steps") - F.col("seqY")).alias("yStart"),
        (F.col("posX") + ahead - F.col("seqX")).alias("xEnd"), (F.col("posY") + ahead - F.col("seqY")).alias("yEnd"),
        length, (F.col("matches") + F.col("more") + k).alias("ident"), score.alias("score"), similarity.alias("similarity"),
    )


def _needed(pairs: DataFrame, blocks: DataFrame, key: list[str], few: bool) -> DataFrame:
    """pairs with the bases of their blocks; if pairs are few, only blocks that they name are shuffled."""
    if few:
        blocks = blocks.join(F.broadcast(pairs.select(*key).distinct()), key, "left_semi")
    return pairs.join(blocks.hint("merge"), key)


def _folded(went: DataFrame, before: DataFrame, names: list[str], schema: pa.Schema, any_wide: bool) -> DataFrame:
    """States after a round; those that looked ahead are put together with what they saw. A state that stayed open looks twice
    as far in the next round."""
    wide = F.col("width") > 1
    alone = went.filter(~wide).select(*[(F.col("width") * 2).alias(c) if c == "width" else F.col(c) for c in names])
    if not any_wide:
        return alone
    walked = before.select("id", F.col("phase").alias("walked"))
    rows = went.filter(wide).join(walked, "id")
    order = [*schema.names, "walked"]
    full = pa.schema([*schema, ("walked", pa.int64())])
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}
    out = ", ".join(f"{n} {kinds[schema.field(n).type]}" for n in names)
    folded = rows.select(*order).repartition("id").sortWithinPartitions("id", "j").mapInArrow(_fold(names, full), out)
    return alone.unionByName(saved(folded, "folded"))
