"""Column functions on bases and words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The complement of each base, U read as T, case kept; other letters stand for themselves.
COMPLEMENT = ("ACGTUacgtu", "TGCAAtgcaa")


#: The two bases of each byte.
_BASES = np.array([list(b"ACGT")[b >> 4 & 3] | list(b"ACGT")[b & 3] << 8 for b in range(256)], "<u2")


def _spelled_bytes(text: pa.Array) -> pa.Array:
    text = pc.fill_null(text, "")
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer((ends - ends[0]) * 2), pa.py_buffer(_BASES[data])).cast(pa.string())


def from_text(text: Column) -> Column:
    """Two bases for each UTF-8 byte; null counts as empty. By arrays: Spark's translate looks each letter up as a string."""
    return F.arrow_udf(_spelled_bytes, "string")(text)


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, *COMPLEMENT))


def index_to_word(index: Column, k: int) -> Column:
    """The index in base 4 as letters, padded with A on the left to k of them."""
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def base_index(letter: Column) -> Column:
    """A 0, C 1, G 2, T 3, other -1."""
    return F.when(F.length(letter) == 1, F.instr(F.lit("ACGT"), letter) - 1).otherwise(-1)


def pack(word: Column) -> Column:
    """A word of up to 32 bases as upper-case hex, two bits for each base, first base highest."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 16)


def packed_word(code: Column) -> Column:
    """The 32-letter word of a packed long."""
    hexed = F.lpad(F.hex(code), 16, "0")
    pairs = {f"{i:X}": "ACGT"[i >> 2] + "ACGT"[i & 3] for i in range(16)}
    # a letter for each hex digit first, so that no replacement meets another's result
    out = F.translate(hexed, "0123456789ABCDEF", "abcdefghijklmnop")
    for i in range(16):
        out = F.replace(out, F.lit("abcdefghijklmnop"[i]), F.lit(pairs[f"{i:X}"]))
    return out


def code_prefix(code: Column, k: int) -> Column:
    """The first k bases of a packed 32-letter word."""
    return F.shiftrightunsigned(code, 2 * (32 - k)) if k < 32 else code
