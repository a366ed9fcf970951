"""Word dictionaries that are made once for each genome and joined where they lie.

A dictionary is a table of the cells of one strand (cells.py), in buckets by cell: the runs of words of a cell are one row, about a byte and a half
a word. Two dictionaries of one store have equal cells and buckets, so their join moves neither. Cells that are too large for one row
are joined word by word, where either side has any. Words with more than HOT places would make a cell as large as they like; they lie beside it in a
table without buckets, and take part, by joins of their own, only where so frequent words are asked for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.dna import code_prefix
from strandmill.operators.cells import CELL, CELLS, WORDS, hits_in_cells, in_cells, often_in_cells, words_in_cells
from strandmill.operators.dictionary import STRIDED, frequent_enough, strided
from strandmill.operators.keyfilter import key_filter
from strandmill.operators.kmers import WORD, kmers
from strandmill.operators.seeds import join_words
from strandmill.sources.blocks import BlockedGenome, strand_of
from strandmill.sources.genomes import totals
from strandmill.storage import saved, small

#: Words with more places are kept apart from the cells; at most STRIDED, so that no word of a cell is ever strided.
HOT = STRIDED
#: Bytes of a group of rows in a file of cells, about.
GROUP = 1 << 24
INFO = "name string, strand string, k int, buckets int, cells int, n_sequences bigint, total_length bigint, n_large bigint, n_hot bigint"


@dataclass
class StoredDictionary:
    """cells: the cells in buckets, n_large of which are more than a row; hot: the words with over HOT places, n_hot different ones."""

    cells: DataFrame
    hot: DataFrame
    strand: str
    k: int
    buckets: int
    n_cells: int
    n_sequences: int
    total_length: int
    n_large: int
    n_hot: int

    @property
    def common(self) -> DataFrame:
        """All words but the hot ones."""
        return self._words(self.cells, HOT)

    def words(self, fl: int) -> DataFrame:
        """The words in cells with at most fl places."""
        return self._words(self.cells, min(fl, HOT)).withColumn("strand", F.lit(self.strand))

    def words_of(self, cells: DataFrame, fl: int, keys: DataFrame | None = None) -> DataFrame:
        """The words of some cells (key) with at most fl places, and no others than those with one of the keys, and a few."""
        own = self.cells.join(cells, "key", "left_semi")
        return self._words(own, min(fl, HOT), keys).withColumn("strand", F.lit(self.strand))

    def _words(self, cells: DataFrame, most: int, keys: DataFrame | None = None) -> DataFrame:
        passing = None if keys is None else key_filter(keys, keys.count())
        words = words_in_cells(cells.filter("whole"), self.k, most, passing)
        if not self.n_large:
            return words
        rest = words_in_cells(cells.filter("not whole"), self.k, keys=passing).drop("num")
        if self.n_hot:
            rest = rest.join(small(saved(self.hot.select("code").distinct(), "hot-words")), "code", "left_anti")
        return words.unionByName(frequent_enough(saved(rest, "words"), most))

    def large(self) -> DataFrame:
        """key of the cells that are more than a row; one for each LARGE words at most."""
        return self.cells.filter("not whole").select("key").distinct()

    def frequent(self, fl: int) -> DataFrame:
        return self.hot.filter(F.col("num") <= fl).withColumn("strand", F.lit(self.strand))


class DictionaryStore:
    """Dictionaries in a folder that driver and executors share, two for each genome's name, all of the same k and numbers of
    buckets and cells. A dictionary counts once its information is written, which is last; what a failed job has left is written over."""

    def __init__(self, spark: SparkSession, root: str, k: int = 32, buckets: int | None = None, cells: int = CELLS):
        self.spark, self.root, self.k, self.cells = spark, root.rstrip("/"), k, cells
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def path(self, name: str, strand: str, part: str) -> str:
        return f"{self.root}/{hashlib.sha256(name.encode()).hexdigest()[:32]}-{strand}/{part}"

    def _table(self, name: str, strand: str) -> str:
        return "words_" + hashlib.sha256(self.path(name, strand, "common").encode()).hexdigest()[:24]

    def _info(self, name: str, strand: str):
        try:
            return self.spark.read.schema(INFO).parquet(self.path(name, strand, "info")).filter("cells IS NOT NULL").first()  # older ones had no cells
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def has(self, name: str, strand: str = "f") -> bool:
        return self._info(name, strand) is not None

    def put(self, name: str, sequences: DataFrame | BlockedGenome, strand: str = "f", mask: str = "skip") -> StoredDictionary:
        """The dictionary of a genome's strand, made if the store hasn't it yet. sequences (of the forward strand) are read several
        times: pass a written table."""
        if not self.has(name, strand):
            self._write(name, sequences, strand, mask)
        return self.get(name, strand)

    def _write(self, name: str, genome: DataFrame | BlockedGenome, strand: str, mask: str) -> None:
        sequences, table = strand_of(genome, strand), self._table(name, strand)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        writer = in_cells(sequences, self.cells, self.buckets, self.k, mask).write.mode("overwrite").option("path", self.path(name, strand, "common")).option("compression", "zstd")
        # Rows are large, and a reader takes up to 4,096 at once, but only of one group.
        writer = writer.option("parquet.block.size", GROUP).option("parquet.page.size.row.check.min", 8).option("parquet.page.size.row.check.max", 64)
        writer.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(table)
        cells = self.spark.table(table)
        pieces = saved(cells.filter("not whole").groupBy("key").agg(F.count(F.lit(1)).alias("pieces")), "pieces")
        n_large = pieces.count()
        many = cells.filter(F.col("whole") & (F.col("n") > HOT)).withColumn("pieces", F.lit(1).cast("bigint"))
        if n_large:
            many = many.unionByName(cells.filter("not whole").join(small(pieces), "key").select(*many.columns))
        suspects = saved(often_in_cells(many, HOT), "suspects")
        n = suspects.count()
        # Only suspects are made into words, and nothing is if there are none.
        keys = (key_filter(suspects, n, "code"), WORD) if n else None
        counts = kmers(sequences, mask, columns=("code",), keys=keys).groupBy("code").agg(F.count(F.lit(1)).alias("num"))
        words = kmers(sequences, mask, keys=keys).withColumn("key", code_prefix(F.col("code"), self.k))
        n_hot = 0
        if n:
            hot = saved(counts.filter(F.col("num") > HOT), "hot-words")  # one for each HOT words at most
            n_hot = hot.count()
            own = words.join(small(hot), "code").select(*[c.split()[0] for c in WORDS.split(", ")])
            own.write.mode("overwrite").parquet(self.path(name, strand, "hot"))
        size = totals(genome.records if isinstance(genome, BlockedGenome) else genome).first()
        values = (name, strand, self.k, self.buckets, self.cells, size["n_sequences"], size["total_length"], n_large, n_hot)
        info = self.spark.range(1).select(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(values, (x.split() for x in INFO.split(", ")), strict=True)])
        info.coalesce(1).write.mode("overwrite").parquet(self.path(name, strand, "info"))

    def get(self, name: str, strand: str = "f") -> StoredDictionary:
        """A dictionary that any session has stored: its files name their buckets, so a new session has only to be told of the table."""
        info = self._info(name, strand)
        if info is None:
            raise KeyError((name, strand))
        if (info.k, info.buckets, info.cells) != (self.k, self.buckets, self.cells):
            raise ValueError(f"{name} is stored with k {info.k} and {info.buckets} buckets of {info.cells} cells")
        table, path = self._table(name, strand), self.path(name, strand, "common").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({CELL}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {info.buckets} BUCKETS LOCATION '{path}'")
        hot = self.spark.read.schema(WORDS).parquet(self.path(name, strand, "hot")) if info.n_hot else self.spark.createDataFrame([], WORDS)
        return StoredDictionary(self.spark.table(table), hot, strand, info.k, info.buckets, info.cells, info.n_sequences, info.total_length, info.n_large, info.n_hot)


def stored_hits(x: StoredDictionary, ys: list[StoredDictionary], fl: int = 1000, cap: int = STRIDED) -> DataFrame:
    """The hits of a stored genome with the stored strands of another: strand, diag, posX, posY, seqX, seqY, as hits makes them
    from sequences.

    The cells in buckets are joined where they lie, without an exchange; each task merges a bucket of either side.
    """
    out = None
    for y in ys:
        if (x.k, x.buckets, x.n_cells) != (y.k, y.buckets, y.n_cells):
            raise ValueError("both dictionaries must have the same k, buckets and cells")
        parts = [hits_in_cells(x.cells, y.cells, y.strand, x.k, min(fl, HOT))]
        if x.n_large or y.n_large:
            parts.append(_large_hits(x, y, fl))
        if fl > HOT and (x.n_hot or y.n_hot):
            parts += _frequent_hits(x, y, fl, cap)
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def _large_hits(x: StoredDictionary, y: StoredDictionary, fl: int) -> DataFrame:
    """Hits of the cells that are more than a row on either side. The keys of y go to x before its words are made."""
    cells = small(saved(x.large().unionByName(y.large()).distinct(), "cells"))
    right = saved(y.words_of(cells, fl), "words")
    left = x.words_of(cells, fl, saved(right.select("key").distinct(), "keys"))
    return join_words(left, right)


def _frequent_hits(x: StoredDictionary, y: StoredDictionary, fl: int, cap: int) -> list[DataFrame]:
    """Hits of words that are frequent on either side."""

    def taken(words: DataFrame, other: DataFrame) -> DataFrame:
        """The words whose key frequent ones of the other side have."""
        return words.join(small(saved(other.select("key").distinct(), "keys")), "key", "left_semi")

    hot_x, hot_y = (saved(d.frequent(fl), "frequent") for d in (x, y))
    if fl >= 2 * cap:  # else no word has a stride above one
        hot_x, hot_y = strided(hot_x, cap), strided(hot_y, cap)
    return [join_words(taken(x.words(fl), hot_y), hot_y), join_words(hot_x, taken(y.words(fl), hot_x)), join_words(hot_x, hot_y)]
