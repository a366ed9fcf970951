"""All pairs of a collection of short records, by pairs of tiles: nothing that grows with the hits is written.

A tile is a stretch of neighbouring records of a genome, packed as one row, with a mark at each word that isn't too frequent. A task holds a
tile of X and takes the tiles that it is wanted with one after another, on both strands: it sorts the words of both, makes hits of equal ones, some
records of X at a time, thins and extends them. What it tells are the accepted fragments, the seeds that may lie in
one, and of all other seeds, of which no fragment takes any, how many have which length and similarity. So what is shuffled is tiles, once for
each tile of X that they meet: that grows with the square of the bases (as the hits do), but by a quarter of a byte for a tile's length of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.extension import _LETTERS, EXTENDED, MATCH
from strandmill.operators.fragments import LAST_LENGTH
from strandmill.operators.keyfilter import mixed
from strandmill.operators.kmers import SLICE, WORD, base_codes, pack_words
from strandmill.operators.placed import run_starts, within
from strandmill.operators.records import went
from strandmill.operators.superwords import stretched
from strandmill.operators.thinning import NOWHERE, walked
from strandmill.storage import BROADCAST_ROWS, saved

#: Bases of a tile at most and at least, and of a record; hits that are made at a time; tiles that a task takes to one tile of X.
TILE, LEAST, LONGEST, HITS, AT_ONCE = 1 << 22, 1 << 18, 1 << 20, 1 << 20, 8
#: Times that the bases of the collection may travel; pairs of genomes.
TRAVEL, PAIRS = 128, 250_000
MOST_TASKS = 4096
#: Bits of a place in a tile: a tile's records begin in TILE bases, and the last may be as long as LONGEST.
BITS = 23
PLACE = np.uint64((1 << BITS) - 1)
ROW = "genome string, tile bigint, first bigint, off bigint, n bigint, records bigint, begin binary, length binary, bases binary, good binary"
#: Rows of extend with accepted, of which sure ones stand for n seeds that no fragment takes: of them only length, at most LAST_LENGTH, and similarity, in
#: whole percent, are told.
FOUND = f"genome_x string, genome_y string, {EXTENDED}, accepted boolean, sure boolean, n bigint"


def _zipped(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unzipped(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n, codec="zstd"), np.uint8) if n else np.empty(0, np.uint8)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by genome, tile and seq, to tiles."""
    key, held, first, off = None, [], 0, 0

    def told() -> pa.RecordBatch:
        length = np.array([len(d) for d in held], np.int32)
        begin = np.append(0, np.cumsum(length[:-1] + 1)).astype(np.int32)
        bases = np.frombuffer(b"\n".join(held), np.uint8)
        row = {"genome": key[0], "tile": key[1], "first": first, "off": off, "n": len(bases), "records": len(held), "begin": _zipped(begin), "length": _zipped(length), "bases": _zipped(bases), "good": b""}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([(c, _ARROW[t]) for c, t in (x.split() for x in ROW.split(", "))]))

    for batch in batches:
        own = (batch.column(c).to_pylist() for c in ("genome", "tile", "seq", "g_off"))
        for dna, genome, tile, seq, g_off in zip(batch.column("dna").cast(pa.binary()), *own, strict=True):
            if (genome, tile) != key:
                if held:
                    yield told()
                key, held, first, off = (genome, tile), [], seq, g_off
            held.append(dna.as_py() or b"")
    if held:
        yield told()


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32()}


@dataclass
class Strand:
    """A tile in the coordinates of a strand. bases: with a letter that is no base between records; off: where it begins; begin, length and seq of its records;
    good: where words begin that aren't too frequent, or None if all aren't."""

    bases: np.ndarray
    off: int
    begin: np.ndarray
    length: np.ndarray
    seq: np.ndarray
    good: np.ndarray | None

    @classmethod
    def of(cls, row: dict) -> Strand:
        n, n_records = row["n"], row["records"]
        begin, length = (_unzipped(row[c], 4 * n_records).view(np.int32).astype(np.int64) for c in ("begin", "length"))
        good = np.unpackbits(_unzipped(row["good"], -(-n // 8)), count=n).astype(bool) if row["good"] else None
        return cls(_unzipped(row["bases"], n), row["off"], begin, length, row["first"] + np.arange(n_records), good)

    def turned(self, n_records: int, span: int) -> Strand:
        """The other strand, of a genome with so many records, and so many places with separators."""
        n = len(self.bases)
        good = None
        if self.good is not None:  # a word's mark lies where it begins
            good = np.zeros(n, bool)
            if n >= WORD:
                good[: n - WORD + 1] = self.good[: n - WORD + 1][::-1]
        return Strand(_LETTERS[self.bases[::-1]], span - self.off - n, (n - self.begin - self.length)[::-1], self.length[::-1], (n_records - 1 - self.seq)[::-1], good)

    def words(self, k: int, mask: str) -> np.ndarray:
        """Sorted: of each word a hash of its first k letters, and in the last bits where it begins."""
        parts = []
        for a in range(0, max(len(self.bases) - WORD + 1, 0), SLICE):
            starts, codes = pack_words(self.bases[a : a + SLICE + WORD - 1], mask)
            starts = starts + a
            if self.good is not None:
                kept = self.good[starts]
                starts, codes = starts[kept], codes[kept]
            parts.append(mixed(codes >> np.uint64(2 * (WORD - k)), 5) & ~PLACE | starts.astype(np.uint64))
        own = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        own.sort()
        return own

    def record(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1


def _met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two sorted lists of words: the places of those of x that y has too, in order, and where in y and how many those are."""
    parts = []
    for a in range(0, len(x) if len(y) else 0, 1 << 19):
        own = x[a : a + (1 << 19)]
        low = np.searchsorted(y, own & ~PLACE)
        at = np.flatnonzero((y[np.minimum(low, len(y) - 1)] ^ own) <= PLACE)
        low, own = low[at], own[at]
        parts.append((own & PLACE, low, np.searchsorted(y, own | PLACE, "right") - low))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    place, low, n = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
    order = np.argsort(place)
    return place[order], low[order], n[order]


def _same(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Whether k base codes agree, eight at a time."""
    wide = [np.ndarray(max(len(c) - 7, 0), np.uint64, c, strides=(1,)) for c in (a, b)]
    same = np.ones(len(p), bool)
    for step in [*range(0, k - 8, 8), k - 8]:
        same &= wide[0][p + step] == wide[1][q + step]
    return same


def _hits(x: Strand, y: Strand, xs: np.ndarray, ys: np.ndarray, codes: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Hits of some records of X at a time, sorted by diagonal and place, as places in both tiles; and from which place of either on
    there may be some. Of one record of X with too many hits, those with some records of Y at a time."""
    place, low, n = _met(xs, ys)
    if not len(place):
        return
    record = x.record(place)
    first = run_starts(record)
    upto = np.cumsum(np.add.reduceat(n, first))
    stops = np.append(first[1:], len(place))

    def made(place: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = np.repeat(place, n), (ys[stretched(low, n)] & PLACE).astype(np.int64)
        own = _same(*codes, p, q, k)
        key = (p[own] - q[own] + (1 << BITS)) << BITS | p[own]
        key.sort()
        p = key & ((1 << BITS) - 1)
        return p, p - (key >> BITS) + (1 << BITS)

    for a, b in within(upto, HITS):
        i, j = int(first[a]), int(stops[b - 1])
        from_x = int(x.begin[record[i]])
        if b - a > 1 or n[i:j].sum() <= HITS:
            yield *made(place[i:j], low[i:j], n[i:j]), from_x, 0
            continue
        # How many of a record's hits each record of Y has, then those of some records of Y.
        counts = np.zeros(len(y.seq), np.int64)
        for c, d in within(np.cumsum(n[i:j]), HITS):
            q = (ys[stretched(low[i + c : i + d], n[i + c : i + d])] & PLACE).astype(np.int64)
            counts += np.bincount(y.record(q), minlength=len(counts))
        keys = ys[low[i:j]] & ~PLACE
        for c, d in within(np.cumsum(counts), HITS):
            begin, end = int(y.begin[c]), int(y.begin[d - 1] + y.length[d - 1])
            lows = np.searchsorted(ys, keys | np.uint64(begin))
            sizes = np.searchsorted(ys, keys | np.uint64(max(end, begin)), "right") - lows
            yield *made(place[i:j], lows, sizes), from_x, begin


def _thinned(p: np.ndarray, q: np.ndarray, x: Strand, y: Strand, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hits that thinning keeps, sorted as they come, with their records."""
    follows = np.append(False, (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1))  # in the same records: no word goes over a separator
    begin = np.flatnonzero(~follows)
    rx, ry = x.record(p[begin]), y.record(q[begin])
    diag = (p - q)[begin]
    new = np.append(True, (diag[1:] != diag[:-1]) | (rx[1:] != rx[:-1]) | (ry[1:] != ry[:-1]))
    kept = walked(p, np.full(len(p), 2 * k), begin[new], np.full(int(new.sum()), NOWHERE))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(p))))[kept]
    return p[kept], q[kept], rx[of], ry[of]


def _seeds(x: Strand, y: Strand, hits: tuple[np.ndarray, np.ndarray, int, int], k: int, lmin: int, simthr: float, longest: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Extended seeds that are accepted or may lie in an accepted fragment, as numbers of FOUND, and of all others lengths, whole percents and
    numbers."""
    p, q, rx, ry = _thinned(*hits[:2], x, y, k)
    end = np.minimum(x.begin[rx] + x.length[rx] - p, y.begin[ry] + y.length[ry] - q)
    best, right, more = went(x.bases, y.bases, p + k, q + k, end - k, np.full(len(p), MATCH * k))
    back = np.minimum(p - x.begin[rx], q - y.begin[ry])
    best, steps, matches = went(x.bases[::-1], y.bases[::-1], len(x.bases) - p, len(y.bases) - q, back, best)
    last = np.where(right > 0, right + k - 1, k)
    length = last + steps + 1
    similarity = (best * 100.0 / (length * MATCH)).astype(np.float32)
    accepted = (length > lmin) & (similarity > np.float32(simthr))
    # A fragment takes seeds of its diagonal only, and of later records none that lie a record's length behind its own.
    diag = p - q
    maybe = np.isin(diag, diag[accepted]) | (p - hits[2] <= longest + 1) | (q - hits[3] <= longest + 1)
    bins, counts = np.unique(np.minimum(length, LAST_LENGTH)[~maybe] * 1000 + np.floor(similarity[~maybe]).astype(np.int64), return_counts=True)
    to = np.flatnonzero(maybe | accepted)
    posX, posY, seqX, seqY = p[to] + x.off, q[to] + y.off, x.seq[rx[to]], y.seq[ry[to]]
    s, e = steps[to], last[to]
    rows = {"diag": posX - posY, "posX": posX, "posY": posY, "seqX": seqX, "seqY": seqY, "xStart": posX - s - seqX, "yStart": posY - s - seqY, "xEnd": posX + e - seqX, "yEnd": posY + e - seqY}
    rows |= {"length": length[to], "ident": (matches + more)[to] + k, "score": best[to], "similarity": similarity[to], "accepted": accepted[to]}
    return rows, bins // 1000, bins % 1000, counts


def _table(x: str, y: str, strand: str, rows: dict[str, np.ndarray], lengths: np.ndarray, percents: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n, m = len(rows["diag"]), len(lengths)
    names = {"genome_x": x, "genome_y": y, "strand": strand}
    told = {"length": lengths, "similarity": percents.astype(np.float32), "accepted": np.zeros(m, bool)}
    numbers = {c: np.concatenate([v, told[c] if c in told else np.zeros(m, v.dtype)]) for c, v in rows.items()}
    numbers |= {"sure": np.append(np.zeros(n, bool), np.ones(m, bool)), "n": np.append(np.ones(n, np.int64), counts)}
    kinds = [c.split() for c in FOUND.split(", ")]
    columns = [pa.repeat(pa.scalar(names[c]), n + m) if c in names else pa.array(numbers[c], _ARROW[t]) for c, t in kinds]
    return pa.RecordBatch.from_arrays(columns, names=[c for c, _ in kinds])


def _too_frequent(tiles: DataFrame, spans: dict[str, int], fl: int, mask: str) -> dict[str, np.ndarray] | None:
    """The words of each genome that have over fl places there, sorted; None if too many are suspected. A word with over fl places has, in one of the tiles, more
    than its share of them; only such suspects are counted in all."""
    def words(row: dict) -> tuple[np.ndarray, np.ndarray]:
        bases = _unzipped(row["bases"], row["n"])
        parts = [pack_words(bases[a : a + SLICE + WORD - 1], mask)[1] for a in range(0, max(len(bases) - WORD + 1, 0), SLICE)]
        code = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        first = run_starts(code)
        return code[first], np.diff(np.append(first, len(code)))

    def told(genome: str, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"genome": pa.array([genome] * len(code), pa.string()), "code": pa.array(code.view(np.int64)), "n": pa.array(n, pa.int64())})

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, n = words(row)
                over = n > fl * row["n"] // max(spans[row["genome"]], 1)
                yield told(row["genome"], code[over], n[over])

    def listed(df: DataFrame) -> dict[str, np.ndarray]:
        own = df.select("genome", "code").toArrow().sort_by("genome")
        genome, code = own["genome"].combine_chunks().dictionary_encode(), own["code"].to_numpy().view(np.uint64)
        cuts = np.searchsorted(genome.indices.to_numpy(), np.arange(len(genome.dictionary) + 1))
        return {g: np.sort(code[a:b]) for g, a, b in zip(genome.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True)}

    of = "genome string, code bigint, n bigint"
    rows = tiles.select("genome", "n", "bases")
    suspects = saved(rows.mapInArrow(suspected, of), "suspects").select("genome", "code").distinct()
    if suspects.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    few = tiles.sparkSession.sparkContext.broadcast(listed(suspects))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["genome"] in few.value:
                    code, n = words(row)
                    own = np.isin(code, few.value[row["genome"]])
                    yield told(row["genome"], code[own], n[own])

    return listed(rows.mapInArrow(counted, of).groupBy("genome", "code").agg(F.sum("n").alias("n")).filter(F.col("n") > fl)) if few.value else {}


def _marked(tiles: DataFrame, often: dict[str, np.ndarray], mask: str) -> DataFrame:
    """tiles with a bit for each place, set but for those of words that are too frequent."""
    told = tiles.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["genome"] in told.value:
                    bases, good = _unzipped(row["bases"], row["n"]), np.ones(row["n"], bool)
                    for a in range(0, max(len(bases) - WORD + 1, 0), SLICE):
                        starts, codes = pack_words(bases[a : a + SLICE + WORD - 1], mask)
                        good[a + starts[np.isin(codes, told.value[row["genome"]])]] = False
                    row["good"] = _zipped(np.packbits(good))
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return tiles.mapInArrow(run, ROW)


def found(sequences: DataFrame, pairs: DataFrame, least: dict[tuple[str, str], int] | int, simthr: float, k: int = 32, fl: int = 1000, mask: str = "skip") -> DataFrame | None:
    """FOUND of all pairs (genome_x, genome_y; all different) of a collection, written; None if a record is too long for it, or tiles would travel too often.
    least: the length that accepted fragments exceed, or that of each pair. sequences is read several times: pass a written table."""
    spark = sequences.sparkSession
    rows = sequences.groupBy("genome").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"), F.max("len").alias("longest")).limit(BROADCAST_ROWS).collect()  # one for each genome
    genomes = {r["genome"]: (r["n"], (r["bases"] or 0) + r["n"] - 1) for r in rows}
    longest, largest = max((r["longest"] or 0 for r in rows), default=0), max((span for _, span in genomes.values()), default=0)
    wanted = pairs.select("genome_x", "genome_y").limit(PAIRS + 1).collect()
    if not 8 <= k <= WORD or longest > LONGEST or len(rows) == BROADCAST_ROWS or len(wanted) > PAIRS:
        return None
    size = min(TILE, max(LEAST, largest // 4))
    partners: dict[str, list[str]] = {}
    for r in wanted:
        if r["genome_x"] in genomes and r["genome_y"] in genomes:
            partners.setdefault(r["genome_x"], []).append(r["genome_y"])
    travels = sum(-(-genomes[x][1] // size) * sum(genomes[y][1] + size // AT_ONCE for y in ys) for x, ys in partners.items())
    if travels > TRAVEL * max(sum(span for _, span in genomes.values()), LEAST):
        return None

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n_tiles = sum(span // size + 1 for _, span in genomes.values())
    names = spark.createDataFrame([(g,) for g in {*partners, *(y for ys in partners.values() for y in ys)}], "genome string")
    tiled = sequences.join(F.broadcast(names), "genome", "left_semi").select("genome", F.floor(F.col("g_off") / size).alias("tile"), "seq", "g_off", "dna")
    tiled = tiled.repartition(min(n_tiles, 4 * tasks), "genome", "tile").sortWithinPartitions("genome", "tile", "seq")
    tiles = saved(tiled.mapInArrow(_packed, ROW), "tiles")
    often = _too_frequent(tiles, {g: span for g, (_, span) in genomes.items()}, fl, mask)
    if often is None:
        return None
    tiles = saved(_marked(tiles, often, mask), "tiles") if often else tiles

    index: dict[str, list[tuple[int, int]]] = {}
    for r in tiles.select("genome", "tile").collect():  # one for each TILE bases, or genome
        index.setdefault(r["genome"], []).append(r["tile"])
    # A group is a tile of X and so many tiles that it is wanted with; each travels with the groups that it belongs to.
    n_x = max(sum(len(index.get(x, ())) for x in partners), 1)
    of_x, of_y, group = [], [], 0
    for x, ys in partners.items():
        others = [(y, t) for y in ys for t in index.get(y, ())]
        each = max(1, min(AT_ONCE, len(others) * n_x // (3 * tasks)))
        for tile in index.get(x, ()):
            for a in range(0, len(others), each):
                of_x.append((x, tile, group))
                of_y += [(*own, group) for own in others[a : a + each]]
                group += 1
    members = spark.createDataFrame([(*m, True) for m in of_x] + [(*m, False) for m in of_y], "genome string, tile bigint, group bigint, is_x boolean")
    dealt = tiles.join(F.broadcast(members), ["genome", "tile"]).repartition(min(max(group, 1), MOST_TASKS), "group").sortWithinPartitions("group", F.col("is_x").desc(), "genome", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, x, xs, xc = "", None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Strand.of(row)
                if row["is_x"]:
                    name, x = row["genome"], own
                    xs, xc = x.words(k, mask), base_codes(x.bases, mask)
                    continue
                lmin = least if isinstance(least, int) else least[name, row["genome"]]
                for strand in "fr":
                    y = own if strand == "f" else own.turned(*genomes[row["genome"]])
                    for hits in _hits(x, y, xs, y.words(k, mask), (xc, base_codes(y.bases, mask)), k):
                        if len(hits[0]):
                            yield _table(name, row["genome"], strand, *_seeds(x, y, hits, k, lmin, simthr, longest))

    return saved(dealt.mapInArrow(run, FOUND), "found")
