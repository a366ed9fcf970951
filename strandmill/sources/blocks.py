"""Genomes as blocks: a narrow table of records, and the bases in rows of at most BLOCK of them.

records: seq, ident, len, g_off, as in genomes.py but for the bases. blocks: seq, block (from 0 in each record), bases, and tail,
the 31 bases that follow, so that a block has all words that begin in it. Only the forward strand is stored; the other one's
places are reckoned from it. A collection's tables have a column genome besides.

FASTA files are read by lines, so that Spark splits them wherever it likes: each split is first read on its own, into pieces with the
number of the record in the split and the place in it; the splits' numbers of records and of bases at either end,
a row for each split, then tell what the pieces' places are in the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.dna import reverse_complement
from strandmill.operators.indexing import with_places
from strandmill.operators.kmers import WORD
from strandmill.sources.genomes import reversed_genome
from strandmill.storage import BROADCAST_ROWS, saved, small

#: Bases of a block.
BLOCK = 1 << 16
PIECES = "file bigint, split bigint, record bigint, at bigint, n bigint, ident string, bases string"


@dataclass
class BlockedGenome:
    records: DataFrame
    blocks: DataFrame
    size: int = BLOCK

    @property
    def keys(self) -> list[str]:
        return ["genome"] if "genome" in self.records.columns else []

    def sizes(self) -> DataFrame:
        """n_sequences and total_length; of a collection, a row for each genome."""
        return self.records.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_length"))

    def strand(self, strand: str) -> DataFrame:
        """seq, len and g_off of the records in a strand's own order, and of, the forward strand's seq."""
        rows = self.records.select(*self.keys, "seq", "len", "g_off").withColumn("of", F.col("seq"))
        if strand == "f":
            return rows
        sizes = self.sizes()
        rows = rows.join(sizes, self.keys) if self.keys else rows.join(F.broadcast(sizes))  # one row
        seq = F.col("n_sequences") - 1 - F.col("seq")
        off = F.col("total_length") + F.col("n_sequences") - 1 - F.col("g_off") - F.col("len")
        return rows.select(*self.keys, seq.alias("seq"), "len", off.alias("g_off"), "of")

    def pieces(self, strand: str = "f") -> DataFrame:
        """What kmers takes as sequences: each block with its tail, and where in the strand it lies. Words of a piece are those
        that begin in its block (in the reverse strand: end in it)."""
        own = self.strand(strand).withColumnRenamed("seq", "own").drop("len")
        lens = self.records.select(*self.keys, F.col("seq").alias("of"), F.col("len").alias("record_len"))
        dna = F.concat("bases", "tail")
        begin = F.col("block") * self.size
        rows = self.blocks.select(*self.keys, F.col("seq").alias("of"), begin.alias("begin"), dna.alias("dna")).join(own.join(lens, [*self.keys, "of"]), [*self.keys, "of"])
        if strand == "r":
            rows = rows.withColumns({"begin": F.col("record_len") - F.col("begin") - F.length("dna"), "dna": reverse_complement(F.col("dna"))})
        return rows.select(*self.keys, F.col("own").alias("seq"), "dna", F.length("dna").cast("bigint").alias("len"), (F.col("g_off") + F.col("begin")).alias("g_off"))


def strand_of(genome: DataFrame | BlockedGenome, strand: str) -> DataFrame:
    """What kmers takes: the sequences of a strand, or the pieces of blocks."""
    if isinstance(genome, BlockedGenome):
        return genome.pieces(strand)
    return genome if strand == "f" else reversed_genome(genome)


def _with_tails(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Only the first bases of a block go to the one before; blocks but the last are full, so one neighbour is enough."""
    if WORD - 1 > size:
        raise ValueError("a block must be longer than a word")
    heads = blocks.filter("block > 0").select(*keys, "seq", (F.col("block") - 1).alias("block"), F.substring("bases", 1, WORD - 1).alias("tail"))
    heads = small(saved(heads, "heads"))  # few where most records are shorter than a block: then the blocks stay where they are
    return blocks.join(heads, [*keys, "seq", "block"], "left").withColumn("tail", F.coalesce("tail", F.lit("")))


def blocked(sequences: DataFrame, size: int = BLOCK, *, wanted: DataFrame | None = None) -> BlockedGenome:
    """Sequences (a genome or a collection) whose records are rows, as blocks, which are written. The records are read off sequences
    when they are asked for: pass a written table. wanted: keys of the records whose blocks are needed; all have their row of records."""
    keys = ["genome"] if "genome" in sequences.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dna = batch.column("dna").cast(pa.binary())
            for i in range(batch.num_rows):
                whole = dna[i].as_buffer() or b""
                cuts = range(0, len(whole), size)
                for part in range(0, len(cuts), 64):
                    own = cuts[part : part + 64]
                    rows = {"block": pa.array([a // size for a in own], pa.int64())}
                    rows |= {c: pa.array([str(memoryview(whole)[x:y], "ascii") for x, y in e], pa.string()) for c, e in (("bases", [(a, a + size) for a in own]), ("tail", [(a + size, a + size + WORD - 1) for a in own]))}
                    yield pa.record_batch({c: pa.repeat(batch.column(c)[i], len(own)) for c in [*keys, "seq"]} | rows)

    rows = sequences.select(*keys, "seq", "dna")
    if wanted is not None:
        rows = rows.join(small(saved(wanted.select(*keys, "seq").distinct(), "wanted")), [*keys, "seq"], "left_semi")
    blocks = rows.mapInArrow(run, "".join(f"{c} string, " for c in keys) + "seq bigint, block bigint, bases string, tail string")
    return BlockedGenome(sequences.select(*keys, "seq", "ident", "len", "g_off"), saved(blocks, "blocks"), size)


def _cut_lines(size: int, schema: pa.Schema):
    """Lines (file, split, value), in order, to pieces of at most `size` bases; each header begins a record of its split, of which
    there is a piece with its ident; record 0 continues what the split before it has left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, record, at, ident, held, n_held = None, 0, 0, None, [], 0
        out: list[tuple] = []

        def flush(whole: bool) -> None:
            """Hands over full pieces, and, if the record ends, what is left, for a header even if that is nothing."""
            nonlocal held, n_held, at, ident
            if n_held >= size or whole:
                bases = b"".join(held)
                end = len(bases) if whole else len(bases) - len(bases) % size
                for a in range(0, end, size):
                    piece = bases[a : min(a + size, end)]
                    out.append((*key, record, at, len(piece), ident, piece.decode()))
                    at, ident = at + len(piece), None
                if whole and ident is not None:
                    out.append((*key, record, at, 0, ident, ""))
                held, n_held = [bases[end:]], len(bases) - end

        def batch_of() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column("value")
            header = pc.starts_with(value, ">").to_numpy(zero_copy_only=False)
            letters = pc.ascii_upper(pc.replace_substring_regex(pc.if_else(header, "", value), "[^A-Za-z]", ""))
            ends, data = np.frombuffer(letters.buffers()[1], np.int32)[letters.offset :], memoryview(letters.buffers()[2] or b"")
            file, split = batch.column("file").to_numpy(), batch.column("split").to_numpy()
            fresh = np.append(False, (file[1:] != file[:-1]) | (split[1:] != split[:-1]))
            cuts = np.flatnonzero(header | fresh)
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                own = (int(file[a]), int(split[a]))
                if own != key:
                    if key is not None:
                        flush(True)
                    key, record, at, ident, held, n_held = own, 0, 0, None, [], 0
                if header[a]:
                    flush(True)
                    record, at, held, n_held = record + 1, 0, [], 0
                    ident = re.match(r"\s*(\S*)", value[int(a)].as_py()[1:])[1]
                held.append(bytes(data[ends[a] : ends[b]]))
                n_held += int(ends[b] - ends[a])
                flush(False)
            if out:
                yield batch_of()
        if key is not None:
            flush(True)
        if out:
            yield batch_of()

    return run


def _placed_splits(pieces: DataFrame) -> DataFrame:
    """file, split, seq (number of the last record that began before the split, in the whole genome), open (its bases before the split);
    open is null where no record of the file has begun."""
    last = F.max(F.struct("record", (F.col("at") + F.col("n")).alias("end")))
    first = F.coalesce(F.sum(F.when(F.col("record") == 0, F.col("n"))), F.lit(0))
    splits = pieces.groupBy("file", "split").agg(F.max("record").alias("headers"), first.alias("first"), last.alias("last"))
    splits = splits.withColumn("adds", F.when(F.col("headers") > 0, F.col("last.end")).otherwise(F.col("first")))
    order = Window.partitionBy("file").orderBy("split")  # a row for each split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("begun", F.coalesce(F.sum("headers").over(before), F.lit(0)))
    # Splits since the last header: what they have, and what that header's split has behind it, is open.
    splits = splits.withColumn("run", F.sum((F.col("headers") > 0).cast("bigint")).over(order))
    run = Window.partitionBy("file", "run").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("upto", F.sum("adds").over(run)).withColumn("open", F.when(F.col("begun") > 0, F.lag("upto").over(order)))
    files = splits.groupBy("file").agg(F.sum("headers").alias("own"))
    ahead = Window.partitionBy().orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("earlier"))
    return splits.join(files, "file").select("file", "split", (F.col("earlier") + F.col("begun") - 1).alias("seq"), "open")


def read_blocks(spark: SparkSession, path: str | list[str], size: int = BLOCK) -> BlockedGenome:
    """One or more FASTA files as one genome, in the order of file names and offsets, its records numbered and named as by read_fasta.

    A record may lie in any number of splits. A line is one task's: bases should stand in lines, as FASTA has them, not in one of
    a whole chromosome.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    names = text.select(F.col("_metadata.file_path").alias("name")).distinct()
    names = saved(names.select("name", F.xxhash64("name").alias("hash"), F.row_number().over(Window.partitionBy().orderBy("name")).cast("bigint").alias("rank")), "files")  # a row for each file
    lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in PIECES.split(", "))])
    pieces = saved(lines.mapInArrow(_cut_lines(size, schema), PIECES), "pieces", "zstd")
    pieces = pieces.join(names.select(F.col("hash").alias("file"), "rank"), "file").drop("file").withColumnRenamed("rank", "file")

    splits = saved(_placed_splits(pieces.drop("bases")), "splits")
    placed = pieces.join(splits, ["file", "split"]).filter("record > 0 OR open IS NOT NULL")  # what precedes a file's first record is passed over
    at = F.when(F.col("record") == 0, F.col("open") + F.col("at")).otherwise(F.col("at"))
    placed = placed.select((F.col("seq") + F.col("record")).alias("seq"), at.alias("at"), "n", "ident", "bases")
    records = placed.groupBy("seq").agg(F.max("ident").alias("ident"), F.sum("n").alias("len"))
    records = with_places(saved(records.withColumn("__step", F.col("len") + 1), "lengths"), "seq", "__step", "__place", "g_off")
    records = saved(records.select("seq", "ident", "len", "g_off"), "records")

    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    parts = placed.filter("n > 0").select("seq", "at", "n", "bases", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * size - F.col("at"), F.col("n"))
    parts = parts.select("seq", "block", (F.col("at") + begin).alias("at"), F.substring(F.col("bases"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("bases"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "bases"))), lambda p: p["bases"]), "")  # of one block
    blocks = saved(parts.groupBy("seq", "block").agg(whole.alias("bases")), "block-bases", "zstd")
    tailed = _with_tails(blocks, [], size)
    if blocks.filter("block > 0").limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # else tails are sent to the blocks whenever these are read
        tailed = saved(tailed, "blocks", "zstd")
    return BlockedGenome(records, tailed, size)


