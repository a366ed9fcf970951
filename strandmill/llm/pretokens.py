"""Batch splitting of texts into the matches of the byte-level BPE pattern, and their encoding.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Where a match begins depends on the classes of a few neighbouring characters only, so the beginnings in a
whole batch are found with array operations; equal matches are then encoded once for a batch, and once
for a worker while they are in its cache: a dictionary for small batches, arrays for large ones.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Bytes of a worker's cache, which is emptied when full, and what an entry takes besides its match and ids.
#: Longer matches than LONG bytes are not kept at all.
CACHED, ENTRY, LONG = 48 << 20, 200, 256
#: Bytes of text encoded at a time; arrays take some fifty times as much.
PIECE = 1 << 20
#: Bytes of text in a large batch, whose matches are looked up together (it is split by pieces), and of the arrays that its cache holds.
BATCH, KEPT = 8 << 20, 32 << 20


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000, dtype="<u4")
    every = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")  # a string for each sign would take 80 MB
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m.group().encode("utf-32-le"), "<u4")] = k
    return out


def match_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions at which a match begins. points: the texts' code points, one separator after
    each text but the last; ends: the separators' positions, and the length. Separators begin too."""
    n = len(points)
    kind = np.full(n + 4, END, np.uint8)
    kind[:n] = classes()[points]
    kind[ends] = END
    now, after = kind[:n], kind[1 : n + 1]
    begins = np.ones(n, bool)
    np.not_equal(now[1:], now[:-1], out=begins[1:])
    begins[ends[:-1]] = True
    runs = begins.copy()
    solid_next = (now == SPACE) & (after != SPACE) & (after != END)  # the last white space before something else
    blank_next = solid_next & (points == 32)
    begins |= solid_next
    begins[1:] &= ~blank_next[:-1]  # a plain space belongs to what follows
    quotes = np.flatnonzero((points == 39) & runs & (now == OTHER))
    if len(quotes):
        quotes = quotes[(quotes == 0) | ~blank_next[quotes - 1]]
        padded = np.append(points, np.zeros(3, points.dtype))
        one = np.where(kind[quotes + 1] == LETTER, padded[quotes + 1], 0)
        two = np.where(kind[quotes + 2] == LETTER, padded[quotes + 2], 0)
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), "<u4"))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[quotes[short | long] + 1] = False
        rest = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        begins[rest[rest < n]] = True
    return begins


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All matches in all texts as one binary array, and for each text the number of matches up to its
    end. texts must not be empty, nor hold 2 GB."""
    joined = "\n".join(texts)
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    begins = match_starts(points, ends)
    at = np.append(np.flatnonzero(begins), len(points))
    if len(data) != len(points):
        width = np.ones(len(points), np.int8)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            width += points > limit
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        offsets = offsets[at]
    else:
        offsets = at
    matches = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return matches, np.searchsorted(at[:-1], ends)


class BatchEncoder:
    """Encodes texts by a function from matches to id lists."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable[list[int]]]):
        self.encode, self.known, self.held = encode, {}, 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        if not texts:
            return []
        matches, ends = split(texts)
        coded = matches.dictionary_encode()
        unique, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if self.held > CACHED:
            self.known.clear()
            self.held = 0
        known, once = self.known, {}
        new = [m for m in unique if m not in known]
        for m, ids in zip(new, self.encode(new), strict=True):
            coded_ids = np.array(ids, np.uint32).tobytes()
            if len(m) > LONG:
                once[m] = coded_ids
            else:
                known[m] = coded_ids
                self.held += len(m) + len(coded_ids) + ENTRY
        parts = [known[m] if m in known else once[m] for m in unique]
        flat = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(sizes) - sizes
        count = sizes[index]
        upto = np.cumsum(count)
        # the k-th id of a match lies at first + k: positions run on by one within a match
        place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(first[index] - (upto - count), count)
        ids = flat[place]
        total = np.concatenate([[0], upto])
        starts = np.concatenate([[0], ends[:-1] + 1])  # a separator is a match of its own, left out here
        return [ids[a:b] for a, b in zip(total[starts].tolist(), total[ends].tolist(), strict=True)]


def runs(texts: list[str], size: int) -> Iterator[list[str]]:
    """Cuts texts into runs of at most `size` characters, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield texts[start:]


class BlockEncoder:
    """Encodes large batches of texts by a function from an array of matches to an order of them, their ids in that order,
    and how many each has."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.ids, self.sizes = pa.array([], pa.binary()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def held(self) -> int:
        return self.keys.nbytes + self.ids.nbytes + self.sizes.nbytes

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        if not texts:
            return []
        cut = [split(part) for part in runs(texts, PIECE)]
        coded = pa.concat_arrays([matches for matches, _ in cut]).dictionary_encode()
        unique, indices = coded.dictionary, coded.indices.to_numpy()
        if self.held() > KEPT:
            self.clear()
        known = pc.index_in(unique, value_set=self.keys)
        missing = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        at = known.fill_null(0).to_numpy().astype(np.int64)
        order, new_ids, new_sizes = self.encode(unique.take(pa.array(missing)))
        at[missing[order]] = len(self.keys) + np.arange(len(missing))
        flat, sizes = np.concatenate([self.ids, new_ids]), np.concatenate([self.sizes, new_sizes])
        first = np.cumsum(sizes) - sizes
        out: list[np.ndarray] = []
        done = 0
        for matches, ends in cut:
            index, done = at[indices[done : done + len(matches)]], done + len(matches)
            count = sizes[index]
            upto = np.cumsum(count)
            total = np.concatenate([[0], upto])
            # the k-th id of a match lies at first + k: positions run on by one within a match
            ids = flat[np.arange(total[-1]) + np.repeat(first[index] - total[:-1], count)]
            starts = np.concatenate([[0], ends[:-1] + 1])  # a separator is a match of its own, left out here
            out += [ids[a:b] for a, b in zip(total[starts].tolist(), total[ends].tolist(), strict=True)]
        new = unique.take(pa.array(missing[order]))
        short = pc.binary_length(new).to_numpy() <= LONG
        self.keys = pa.concat_arrays([self.keys, new.filter(pa.array(short))])
        self.ids = np.concatenate([self.ids, new_ids[np.repeat(short, new_sizes)]])
        self.sizes = np.concatenate([self.sizes, new_sizes[short]])
        return out


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
