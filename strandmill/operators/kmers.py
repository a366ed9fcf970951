"""32-letter words of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.dna import packed_word
from strandmill.operators.keyfilter import ANCHOR, APART, passes

WORD = 32
#: Bases taken at a time, so that memory doesn't grow with a record.
SLICE = 1 << 20
#: Bases of short records that are taken together, about, so that a record costs no calls of its own; words that are handed over together, about.
TAKEN, ROWS = 1 << 16, 1 << 16


def base_codes(bases: np.ndarray, mask: str) -> np.ndarray:
    """0 to 3 for A, C, G and T, 255 for any other byte. mask: what lower-case bases are, "skip" (no bases) or "upper"."""
    codes = np.full(256, 255, np.uint8)
    for i, letter in enumerate(b"ACGT"):
        codes[letter] = i
        if mask == "upper":
            codes[letter + 32] = i
    return codes[bases]


def words_of(codes: np.ndarray) -> np.ndarray:
    """The packed word that begins at each base code but the last ones."""
    words, n = codes.astype(np.uint64), 1
    while n < WORD:  # words of 2n letters from pairs of words of n
        words = words[:-n] << np.uint64(2 * n) | words[n:]
        n *= 2
    return words


def pack_words(bases: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the valid words of a byte array, and their packed values."""
    x = base_codes(bases, mask)
    bad = np.concatenate([[0], np.cumsum(x > 3)])
    starts = np.flatnonzero(bad[WORD:] == bad[:-WORD])
    return starts, words_of(x)[starts]


def anchored_words(bases: np.ndarray, mask: str, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pack_words, but for words whose first anchor doesn't pass the filter of anchors."""
    n = len(bases) - WORD + 1
    x = base_codes(bases, mask)
    units = np.zeros(-(-len(x) // APART) * APART + 2 * WORD, np.uint8)
    units[: len(x)] = x & 3
    units = units[::2] << 2 | units[1::2]
    units = (units[::2] << 4 | units[1::2]).view(">u2").astype(np.uint64)  # APART letters each
    per, after = APART * 2, ANCHOR // APART
    places = units[:-after].copy()
    for i in range(1, after):
        places = places << np.uint64(per) | units[i : i - after]
    found = np.flatnonzero(passes(anchors, places[: -(-n // APART) + 1].view(np.int64)))
    starts = (found[:, None] * APART + np.arange(1 - APART, 1)).ravel()
    starts = starts[(starts >= 0) & (starts < n)]
    if (x > 3).any():
        bad = np.concatenate([[0], np.cumsum(x > 3)])
        starts = starts[bad[starts + WORD] == bad[starts]]
    unit, shift = starts // APART, (2 * (starts % APART)).astype(np.uint64)
    words = np.zeros(len(starts), np.uint64)
    for i in range(WORD // APART):
        words = words << np.uint64(per) | units[unit + i]
    return starts, words << shift | units[unit + WORD // APART] >> np.uint64(per) - shift


def kmers(sequences: DataFrame, mask: str = "skip", label: str | None = None, columns: tuple[str, ...] = ("code", "seq", "pos"), keys: tuple[Broadcast, int] | None = None, anchors: Broadcast | None = None) -> DataFrame:
    """Of code (packed word as a long), seq and pos (place in the whole genome) those named, and the string
    column `label` of the sequence if one is named. Spark can't see which columns are used later, so name
    only those. Any letter but A, C, G and T ends a word; records never share one. keys: a filter of keys and their number of letters;
    words whose first letters don't pass are not made into rows; anchors: a filter of the anchors of all keys that pass."""
    names = [label] if label else []

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_parts, held, n_held = [], 0, [], 0

        def cut() -> None:
            """Words of some pieces of records, between which a letter stands that is no base."""
            nonlocal parts, n_parts, n_held
            whole = np.frombuffer(b"\n".join(p[0] for p in parts), np.uint8)
            starts, codes = anchored_words(whole, mask, anchors.value) if anchors else pack_words(whole, mask)
            if keys:
                few = passes(keys[0].value, codes >> np.uint64(2 * (WORD - keys[1])))
                starts, codes = starts[few], codes[few]
            if len(starts):
                begin = np.cumsum([0] + [len(p[0]) + 1 for p in parts[:-1]])
                of = np.searchsorted(begin, starts, "right") - 1
                seq, off = (np.array([p[i] for p in parts], np.int64) for i in (1, 2))
                made = {"code": lambda: codes.view(np.int64), "seq": lambda: seq[of], "pos": lambda: (off - begin)[of] + starts}
                own = {c: pa.array(made[c](), pa.int64()) for c in columns}
                held.append(own | {c: pa.array([p[3 + i] for p in parts], pa.string()).take(pa.array(of)) for i, c in enumerate(names)})
                n_held += len(starts)
            parts, n_parts = [], 0

        def told() -> pa.RecordBatch:
            nonlocal held, n_held
            own, held, n_held = held, [], 0
            return pa.record_batch({c: pa.concat_arrays([o[c] for o in own]) for c in (*columns, *names)})

        for batch in batches:
            kept = [batch.column(c).to_pylist() for c in names]
            for dna, seq, off, *more in zip(batch.column("dna").cast(pa.binary()), batch.column("seq").to_pylist(), batch.column("g_off").to_pylist(), *kept, strict=True):
                bases = memoryview(dna.as_buffer()) if dna.is_valid else b""
                for a in range(0, max(len(bases) - WORD + 1, 0), SLICE):
                    parts.append((bases[a : a + SLICE + WORD - 1], seq, off + a, *more))
                    n_parts += len(parts[-1][0])
                    if n_parts >= TAKEN:
                        cut()
                        if n_held >= ROWS:
                            yield told()
        if parts:
            cut()
        if held:
            yield told()

    return sequences.select("dna", "seq", "g_off", *names).mapInArrow(words, ", ".join([*[f"{c} bigint" for c in columns], *[f"{c} string" for c in names]]))


def spelled(words: DataFrame) -> DataFrame:
    """The word itself in place of its code."""
    return words.withColumn("word", packed_word(F.col("code"))).drop("code")


def with_prefix(words: DataFrame, prefix: str) -> DataFrame:
    """Words that start with a prefix of 1 to 31 letters."""
    value = int("".join(str("ACGT".index(c)) for c in prefix), 4)
    return words.filter(F.shiftrightunsigned("code", 2 * (WORD - len(prefix))) == value)


def with_prefixes(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The words of each of the prefixes, with the columns of its row. prefixes: prefix (1 to 31 letters) and
    others; a workload of a few thousand rows at most. Prefixes of different lengths may overlap."""
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]
    out = None
    for n in sorted(lengths):
        value = F.conv(F.translate("prefix", "ACGT", "0123"), 4, 10).cast("bigint")
        own = prefixes.filter(F.length("prefix") == n).withColumn("__key", value)
        found = words.withColumn("__key", F.shiftrightunsigned("code", 2 * (WORD - n))).join(F.broadcast(own), "__key").drop("__key")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no prefixes")
    return out
