"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Documents are dealt by ranges of their identifiers, encoded, and each partition writes one file:

    b"ZTIDS1\\n", id width in bytes (1 byte), dictionary SHA-256 (32 bytes), frames one after another,
    index, index length (8 bytes), b"ZTIDX1\\n"

The index holds for each document its identifier, its frame's offset, its first id's place in the file and
its number of ids, so one short document is read with two small reads. The dictionary is trained on the serialised ids
of a bounded sample and lies beside the files under its hash. A file gets a name of its own for each task
attempt, and only the names that a successful attempt returned are in the manifest, so retries and lost
executors leave no half-written file that anything reads. Files are written with pyarrow's file systems,
as Spark has no writer for opaque files; they are read back the same way.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, named, partitions, pieces, split_uri, table, work_path
from strandmill.llm.pretokens import BATCH, BlockEncoder

HEAD, TAIL = b"ZTIDS1\n", b"ZTIDX1\n"
LEVEL, DICTIONARY_BYTES = 3, 65_536
#: The dictionary is trained on this many documents at most, those with the smallest hashes, and of each on
#: so many pieces of so many characters (of short texts: ids), spread evenly over it: some 8 MB at two bytes an id. It decides
#: sizes only, never contents.
SAMPLE_ROWS, SAMPLE_PIECES, PIECE_CHARS, PIECE_IDS = 512, 16, 2_560, 512
BATCH_IDS = 1 << 20
#: Matches that the tokenizer gets as one text.
JOINED = 1_000
INDEX = np.dtype([("doc_id", "<i8"), ("named", "<u1"), ("offset", "<u8"), ("size", "<u8"), ("start", "<u8"), ("n", "<u8")])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_width(path: str) -> int:
    """Bytes that hold every id of the vocabulary: 2 or 4."""
    return 2 if max(load(path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4


def match_encoder(tokenizer) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For BlockEncoder: the ids of matches, as the library gives them.

    A call costs the library more than a match, so matches that begin with a space and a letter or digit are handed over in runs,
    as one text each: however they follow one another, the pattern splits them at their spaces. Which ids are
    whose is told by the bytes that they stand for; where these don't add up, matches go one by one.
    """
    lengths = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, np.int64)
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        lengths[k] = len(token)  # a character of the byte-level alphabet for each byte

    def call(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(matches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = matches.cast(pa.string())
        spaced = pc.match_substring_regex(words, r"^ [\pL\pN]").to_numpy(zero_copy_only=False)
        together, alone = np.flatnonzero(spaced), [np.flatnonzero(~spaced)]
        ends = np.cumsum(pc.binary_length(matches).to_numpy()[together].astype(np.int64))
        text = b"".join(matches.filter(pa.array(spaced)).to_pylist())
        cuts = [0, *ends[JOINED - 1 :: JOINED].tolist()]
        cuts += [len(text)] if cuts[-1] < len(text) else []
        order, found, sizes = [], [], []
        for k, ids in enumerate(call([text[a:b].decode() for a, b in zip(cuts, cuts[1:])])):
            own, upto = together[k * JOINED : (k + 1) * JOINED], ends[k * JOINED : (k + 1) * JOINED] - cuts[k]
            reached = np.cumsum(lengths[ids])
            last = np.searchsorted(reached, upto)
            if not len(ids) or reached[-1] != upto[-1] or not np.array_equal(reached[last], upto):
                alone.append(own)
                continue
            order.append(own)
            found.append(ids)
            sizes.append(np.diff(last, prepend=-1))
        rest = np.concatenate(alone)
        single = call(words.take(pa.array(rest)).to_pylist())
        counts = np.fromiter(map(len, single), np.int64, len(single))
        return np.concatenate([*order, rest]), np.concatenate([*found, *single, np.empty(0, np.uint32)]), np.concatenate([*sizes, counts]).astype(np.int64)

    return encode


@lru_cache(1)
def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes as the tokenizers library does without adding special tokens, but each distinct match of the
    splitting pattern once for a worker, whose later tasks find it in the bounded cache. Texts that hold an added token's
    string go to the library whole."""
    tokenizer = load(path)
    batch = BlockEncoder(match_encoder(tokenizer))
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    holds = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    def encode(texts: list[str]) -> list[np.ndarray]:
        plain = iter(batch([t for t in texts if not holds(t)]))
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if holds(t) else next(plain) for t in texts]

    return encode


def cut(text: Column, pieces: int = SAMPLE_PIECES, size: int = PIECE_CHARS) -> Column:
    """A text whole, or, if it is longer than that, `pieces` pieces of it, spread evenly: so that no long text travels for the sample."""
    n = F.length(text)
    at = [F.floor((n - size) * i / (pieces - 1)).cast("int") + 1 for i in range(pieces)]
    return F.when(n <= pieces * size, F.array(text)).otherwise(F.array(*[F.substring(text, a, F.lit(size)) for a in at]))


def sampled(ids: np.ndarray, pieces: int = SAMPLE_PIECES, size: int = PIECE_IDS) -> list[np.ndarray]:
    """Up to `pieces` pieces of ids, spread evenly."""
    if len(ids) <= pieces * size:
        return [ids[i : i + size] for i in range(0, len(ids), size)]
    return [ids[a : a + size] for a in np.linspace(0, len(ids) - size, pieces).astype(int).tolist()]


def serialised(ids: np.ndarray, end: int | None, width: int) -> bytes:
    """Little-endian ids with the end id, `width` bytes each; ids that need more raise ValueError."""
    ids = ids if end is None else np.append(ids, np.uint32(end))
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"id {ids.max()} needs more than {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Raw bytes of a dictionary; of the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str, dictionary: bytes):
        system, path = split_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(len(HEAD) + 33, 0)
        tail = self.file.read_at(8 + len(TAIL), size - 8 - len(TAIL))
        if head[: len(HEAD)] != HEAD or tail[8:] != TAIL or head[-32:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file, or written with another dictionary")
        self.width = head[len(HEAD)]
        length = int.from_bytes(tail[:8], "little")
        self.index = np.frombuffer(self.file.read_at(length, size - 8 - len(TAIL) - length), INDEX)
        self.plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        x = self.index[k]
        frame = self.file.read_at(int(x["size"]), int(x["offset"]))
        return np.frombuffer(self.plain.decompress(frame, max_output_size=max(1, int(x["n"]) * self.width)), f"<u{self.width}")


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int | None = 0, width: int | None = None) -> tuple[DataFrame, str]:
    """Writes the files into a new shared folder; returns the manifest (file, part, documents, tokens) with
    a row for each file, and the folder. Null texts count as empty; documents stand by identifier (nulls
    first), repeated ones by a hash of their text. width: bytes of an id, those that the vocabulary needs
    if None."""
    spark = docs.sparkSession
    path = path or vocabulary()
    width = width or id_width(path)
    folder = work_path(spark, "tokens")
    system, root = split_uri(folder)
    system.create_dir(root)
    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in pieces(batch.column("text"), BATCH):
                yield pa.record_batch({"ids": pa.array([serialised(piece, None, width) for x in encode(part.to_pylist()) for piece in sampled(x)], pa.binary())})

    chosen = rows.select("doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(SAMPLE_ROWS)
    most = chosen.agg(F.max("h")).first()[0]
    few = rows.filter(F.xxhash64("doc_id") <= F.lit(most if most is not None else 0)).select(cut(F.col("text")).alias("cuts")).limit(2 * SAMPLE_ROWS)
    few = few.repartition(partitions(spark)).select(F.explode("cuts").alias("text"))
    samples = [r.ids for r in few.mapInArrow(sample, "ids binary").collect()]
    dictionary = train_dictionary(samples) if samples else b""
    name = hashlib.sha256(dictionary).hexdigest()
    with system.open_output_stream(f"{root}/{name}.dict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, words = encoder(path), shared.value
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        own = f"{folder}/{uuid.uuid4().hex}.ztids"
        index: list[tuple[int, int, int, int, int, int]] = []
        system, target = split_uri(own)
        out, at, total = None, len(HEAD) + 33, 0
        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for part in pieces(batch.column("text"), BATCH):
                if out is None:
                    out = system.open_output_stream(target)
                    out.write(HEAD + bytes([width]) + hashlib.sha256(words).digest())
                for ids in encode(part.to_pylist()):
                    data, name = serialised(ids, end, width), next(names)
                    frame = pack.compress(data)
                    out.write(frame)
                    index.append((name or 0, name is not None, at, len(frame), total, len(data) // width))
                    at, total = at + len(frame), total + len(data) // width
        if out is not None:
            table = np.array(index, INDEX).tobytes()
            out.write(table + len(table).to_bytes(8, "little") + TAIL)
            out.close()  # only a whole file gets into the manifest
            yield pa.record_batch({"file": [own], "documents": [len(index)], "tokens": [total]})

    n = partitions(spark)
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = dealt.select("doc_id", "text").mapInArrow(write, "file string, documents bigint, tokens bigint").withColumn("part", F.spark_partition_id())
    return materialize(manifest, "manifest"), folder


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, read from them. files: file,
    and before, the number of ids in all earlier files; one row for each."""
    spark = files.sparkSession
    system, root = split_uri(folder)
    names = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.path.endswith(".dict")]
    with system.open_input_stream(names[0]) as lines:
        shared = spark.sparkContext.broadcast(lines.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                tokens = TokenFile(name, shared.value)
                a = 0
                while a < len(tokens):  # some BATCH_IDS ids at a time, or one longer document
                    upto = int(np.searchsorted(tokens.index["start"], tokens.index["start"][a] + BATCH_IDS))
                    index = tokens.index[a : max(upto, a + 1)]
                    own = [tokens.ids(k) for k in range(a, a + len(index))]
                    a += len(index)
                    yield pa.record_batch({"doc_id": pa.array(index["doc_id"].astype(np.int64), mask=index["named"] == 0), "start": pa.array(index["start"].astype(np.int64) + before), "n_tokens": pa.array([len(x) for x in own], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())})

    return files.select("file", "before").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def placed(manifest: DataFrame) -> DataFrame:
    """file, before: the files with the number of ids in all files before, in the order of their parts."""
    before = F.sum("tokens").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What token files of documents hold, read back from them. Null texts count as empty, null identifiers
    come first, repeated rows are stored each, an empty table gives no rows."""
    manifest, folder = write_tokens(table(spark, sf_dir, "documents"))
    return read_tokens(placed(manifest).repartition(partitions(spark), "file"), folder)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
