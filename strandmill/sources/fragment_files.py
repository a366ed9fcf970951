"""Fragment files: a header with both lengths, then records of 93 bytes, all big-endian."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed layout of a record.
RECORD = np.dtype([("diag", ">i8"), ("xStart", ">i8"), ("yStart", ">i8"), ("xEnd", ">i8"), ("yEnd", ">i8"), ("length", ">i8"), ("ident", ">i8"), ("score", ">i8"), ("similarity", ">f4"), ("seqX", ">i8"), ("seqY", ">i8"), ("block", ">i8"), ("strand", "S1")])
HEADER = np.dtype([("lenX", ">u8"), ("lenY", ">u8")])
SCHEMA = ", ".join(f"{n} {'float' if n == 'similarity' else 'string' if n == 'strand' else 'bigint'}" for n in RECORD.names)
#: Bytes that a task reads; records of a batch.
SPLIT, BATCH = 64 << 20, 50_000


def packed(batch: pa.RecordBatch) -> bytes:
    """The records of a batch."""
    rows = np.zeros(batch.num_rows, RECORD)
    for name in RECORD.names:
        rows[name] = [s.encode() for s in batch.column(name).to_pylist()] if name == "strand" else batch.column(name).to_numpy()
    return rows.tobytes()


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


@dataclass
class Range(InputPartition):
    """Whole records of a file: the first one and their number."""

    file: str
    first: int
    n: int


@dataclass
class Written(WriterCommitMessage):
    """A task's file, under a hidden name, or none without fragments."""

    partition: int
    hidden: str | None


class FragmentReader(DataSourceReader):
    """Files are planned as ranges of whole records, so that any number of tasks reads one."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        system, root = located(self.path)
        found = system.get_file_info(fs.FileSelector(root)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        out, step = [], max(1, self.size // RECORD.itemsize)
        for info in sorted(found, key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                n = (info.size - HEADER.itemsize) // RECORD.itemsize
                out += [Range(info.path, first, min(step, n - first)) for first in range(0, n, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.file) as data:
            data.seek(HEADER.itemsize + partition.first * RECORD.itemsize)
            for at in range(0, partition.n, BATCH):
                rows = np.frombuffer(data.read(min(BATCH, partition.n - at) * RECORD.itemsize), RECORD)
                rows = rows[rows["length"] > 0]
                yield pa.record_batch({n: pa.array([s.decode() for s in rows[n]], pa.string()) if n == "strand" else pa.array(rows[n].astype(rows[n].dtype.newbyteorder("="))) for n in RECORD.names})


class FragmentWriter(DataSourceArrowWriter):
    """Tasks write under hidden names; when all have ended well the driver gives the files their names, else it deletes them."""

    def __init__(self, path: str, len_x: int, len_y: int):
        self.path, self.lengths = path, (len_x, len_y)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        hidden, out = f"{root}/.{uuid.uuid4().hex}", None
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    out = system.open_output_stream(hidden)
                    out.write(np.array([self.lengths], HEADER).tobytes())
                out.write(packed(batch))
        if out is not None:
            out.close()
        return Written(TaskContext.get().partitionId(), hidden if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        full = [m for m in messages if m and m.hidden]
        for m in full:
            system.move(m.hidden, f"{root}/part-{m.partition:06d}.frags")
        if not full:
            with system.open_output_stream(f"{root}/part-none.frags") as out:
                out.write(bytes(HEADER.itemsize))

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            if m and m.hidden:
                system.delete_file(m.hidden)


class FragmentSource(DataSource):
    """Spark's format "fragments". Options: path; to write len_x and len_y, the lengths of both genomes; to read split, the bytes of a
    task."""

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FragmentReader:
        return FragmentReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options["path"], int(self.options["len_x"]), int(self.options["len_y"]))


def write_fragments(fragments: DataFrame, len_x: int, len_y: int, path: str) -> None:
    """Writes a folder of fragment files, one for each partition that has any, each with the header. Without
    fragments there is one file with a header of zeros and no records. A failed attempt leaves nothing that is read."""
    system, root = located(path)
    system.create_dir(root)
    fragments.sparkSession.dataSource.register(FragmentSource)
    rows = fragments.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))])
    rows.write.format("fragments").options(path=path, len_x=len_x, len_y=len_y).mode("append").save()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """file, len_x, len_y from the header of each file."""

    def number(at: int):
        return F.conv(F.hex(F.substr("content", F.lit(at), F.lit(8))), 16, 10).cast("bigint")

    return _files(spark, path).select(F.col("path").alias("file"), number(1).alias("len_x"), number(9).alias("len_y"))


def read_fragment_files(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The fragments of a file or of all files of a folder; records without length are left out. split: bytes of a task."""
    spark.dataSource.register(FragmentSource)
    return spark.read.format("fragments").options(path=path, split=split).load()
