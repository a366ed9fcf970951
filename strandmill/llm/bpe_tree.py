"""Byte-level BPE as a reduction over a tree of text halves.

A text is halved until its parts are short, the parts of a whole batch are encoded together, and
neighbours are joined up the tree. To join, the text around the seam is encoded anew in a window that
grows until both its edges are boundaries of the splitting pattern whatever stands beyond them: there no
match can reach across, so all tokens outside stay as they are and the join equals the encoding of the
joined text. That makes the encoding a monoid homomorphism, and joins may be grouped in any way.
Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import lean, named, pieces, table
from strandmill.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, BatchEncoder, classes, ranks

#: Code points of a part that is not halved further, and of the first window on either side of a seam.
LEAF, WINDOW = 4096, 64
#: Bytes of text whose parts are encoded together; arrays take some fifty times as much.
PART = 1 << 19


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def fixed_boundaries(text: str) -> np.ndarray:
    """Positions in text, 1 at least, that are match boundaries whatever precedes or follows text.

    No match holds white space after anything else, nor a number beside a letter or other sign, nor
    another sign after a letter. (A letter after another sign may belong to it: 's.)
    """
    kind = classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    a, b = kind[:-1], kind[1:]
    fixed = (a != SPACE) & ((b == SPACE) | ((a != b) & ~((a == OTHER) & (b == LETTER))))
    return np.flatnonzero(fixed) + 1


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.leaf, self.window = leaf, window
        by_bytes = ranks(path)
        merges = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=by_bytes, special_tokens={})
        self.batch = BatchEncoder(lambda new: map(merges._core_bpe.encode_single_piece, new))
        self.bytes_of = [b""] * (max(by_bytes.values()) + 1)
        for piece, i in by_bytes.items():
            self.bytes_of[i] = piece
        self.size_of = np.array(list(map(len, self.bytes_of)), np.int64)

    def halves(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return [text]
        mid = len(text) // 2
        return self.halves(text[:mid]) + self.halves(text[mid:])

    def tokens_in(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids make up `size` bytes; size must be a token boundary."""
        step, done, count = 64, 0, 0
        while done < size:
            sums = done + np.cumsum(self.size_of[ids[count : count + step]])
            k = int(np.searchsorted(sums, size)) + 1
            k = min(k, len(sums))
            done, count, step = int(sums[k - 1]), count + k, step * 4
        return count

    def join(self, a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        (left, ids), (right, more) = a, b
        if not left or not right:
            return left + right, np.concatenate([ids, more])
        w = self.window
        while True:
            tail, head = left[-w:], right[:w]
            cuts, ends = fixed_boundaries(tail), fixed_boundaries(head)
            if (len(cuts) or w >= len(left)) and (len(ends) or w >= len(right)):
                break
            w *= 2
        # the window starts at the last fixed boundary on the left, or with the text, and ends at the first on the right
        redo_left = tail[cuts[-1] :] if len(cuts) else left
        redo_right = head[: ends[0]] if len(ends) else right
        keep = len(ids) - self.tokens_in(ids[::-1], len(redo_left.encode()))
        drop = self.tokens_in(more, len(redo_right.encode()))
        (middle,) = self.batch([redo_left + redo_right])
        return left + right, np.concatenate([ids[:keep], middle, more[drop:]])

    def up(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        leaves = [self.halves(t) for t in texts]
        coded = iter(self.batch([part for own in leaves for part in own]))
        return [self.up([(part, next(coded)) for part in own]) for own in leaves]

    def decode(self, ids: np.ndarray) -> bytes:
        get = self.bytes_of.__getitem__
        parts = [b"".join(map(get, ids[i : i + self.leaf].tolist())) for i in range(0, len(ids), self.leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


RESULT = "struct<n_tokens: bigint, ids: array<int>, ids_sha256: string, decoded_sha256: string>"


def tree_bpe(text: Column, path: str | None = None, with_ids: bool = True) -> Column:
    """Struct of n_tokens, ids (null unless with_ids), ids_sha256 and decoded_sha256 of each text.

    Null counts as empty; an empty text has no tokens. Special tokens' strings are ordinary text. A text
    is held by one task, in parts; batches are cut to some hundred KB.
    """
    path = path or vocabulary()

    @F.arrow_udf(RESULT)
    @lean
    def bpe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = TreeEncoder(path)
        decimal = [str(i) for i in range(len(tree.bytes_of))].__getitem__
        for batch in batches:
            ids, digests, decoded = [], [], []
            for part in pieces(batch, PART):
                for own in tree.encode([x or "" for x in part.to_pylist()]):
                    ids.append(own)
                    digests.append(hashlib.sha256(" ".join(map(decimal, own.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(tree.decode(own)).hexdigest())
            counts = np.array([len(x) for x in ids], np.int64)
            if with_ids:
                flat = np.concatenate(ids).view(np.int32) if ids else np.empty(0, np.int32)
                ids.clear()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int32()))
            else:
                lists = pa.nulls(len(ids), pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([pa.array(counts), lists, pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return bpe(text)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs with all rows and columns and a struct column `bpe` (replaced if there is one)."""
    return docs.withColumn("bpe", tree_bpe(named(text_col), path, with_ids))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and its bytes decoded from them. Null counts as empty, an empty text has no
    tokens, repeated rows are encoded each, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, with_ids=False).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
