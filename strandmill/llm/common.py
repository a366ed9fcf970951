"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if the session names no shared folder; on one machine only.
LOCAL_WORK_DIR = "file:///tmp/checkpoints"
#: Narrow rows (some 100 bytes) that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_KEYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_WORK_DIR
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths written inside of the innermost open scratch() of this thread.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are written inside are deleted at the end, but for those taken off the list of paths."""
    paths: list[str] = []
    outer = _scratch.set(paths)
    try:
        yield paths
    finally:
        _scratch.reset(outer)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _written(path: str) -> None:
    paths = _scratch.get()
    if paths is not None:
        paths.append(path)


def materialized_from(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of make(), whose own tables are deleted."""
    with scratch(spark) as paths:
        out = materialize(make(), name)
        kept = paths.pop()
    _written(kept)
    return out


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps neither recompute it
    nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    _written(path)
    return spark.read.schema(df.schema).parquet(path)


def split_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, for files that Spark has no writer for."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def text_digest(text: Column) -> Column:
    """SHA-256; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def without(docs: DataFrame, odd: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, all their columns, but for those whose identifier and text_digest are in odd (id,
    digest, stays; each once); of the rows of a pair that stays, one is left.

    While odd is small, documents are only filtered, without a shuffle. Rows of the same identifier and text are
    interchangeable: all but one for each task are dropped before they travel.
    """
    odd = odd.select(F.col("id").alias("odd_id"), F.col("digest").alias("odd_digest"), "stays")
    rows = docs.select(F.struct(*all_columns(docs)).alias("row"), named(id_col).alias("id"), text_digest(named(text_col)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("digest") == F.col("odd_digest"))
    alone = rows.join(few(odd), same, "left_anti").select("row.*")
    repeated = odd.filter("stays")
    if not repeated.limit(1).count():
        return alone
    return alone.union(rows.join(few(repeated), same, "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*"))


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they were counted to be few. Counts them: pass a written table."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def named(column: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def all_columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """Cuts a string or binary column into runs of rows of at most max_bytes (one row at least), so
    that what a task holds for a batch is bounded by that or by its longest text."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > max_bytes:
            yield column.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(column):
        yield column.slice(start)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which works on the batches of a task; what a batch took goes back to the system behind it, as workers live on
    through later stages."""

    @wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            hand_back()
        hand_back()

    return trimmed


def hand_back() -> None:
    """Gives memory that is free in this process to the system: Arrow's, and the C library's if it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
