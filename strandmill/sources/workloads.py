"""Text inputs that steer a comparison: word prefixes, commands, length thresholds."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line")).filter(F.length(F.trim("line")) > 0)


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """rank, line: the lines of a workload file, counted from 0 as workers are. A last line without a line
    end doesn't count. One row for each worker."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    return text.select(F.posexplode(F.slice("lines", F.lit(1), F.size("lines") - 1)).alias("rank", "line"))


def write_workload(workload: DataFrame, path: str) -> None:
    """A line for each rank, in order."""
    workload.repartition(1).sortWithinPartitions("rank").select("line").write.text(path)  # one row for each worker


def flags(line: Column) -> Column:
    """Struct of query, and of out with its first two parts between dots as prefix and suffix, from a command
    line with `-query FILE -out FILE`; null where a flag or part is missing."""
    def value(flag: str) -> Column:
        found = F.regexp_extract(line, rf"(?:^|\s)-{flag}\s+(\S+)", 1)
        return F.when(found != "", found)

    out = value("out")
    parts = F.filter(F.split(out, r"\."), lambda p: p != "")
    return F.struct(value("query").alias("query"), out.alias("out"), F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("suffix"))


def prefixes(lines: DataFrame) -> DataFrame:
    """rank, prefix: the comma-separated prefixes of each line. lines: rank, line."""
    return lines.select("rank", F.explode(F.split("line", ",")).alias("prefix")).select("rank", F.trim("prefix").alias("prefix")).filter("prefix <> ''")


def arguments(line: Column) -> Column:
    """The words of a command line."""
    return F.filter(F.split(line, " "), lambda w: w != "")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="length int, low int, up int")


def command_lines(chunks: DataFrame, command: str, query: str, out: str) -> DataFrame:
    """chunk, line: the command of each chunk, reading and writing files with the chunk's number."""
    return chunks.select("chunk", F.format_string(f"{command} -query {query}-%04d -out {out}-%04d", "chunk", "chunk").alias("line"))


def run_commands(lines: DataFrame, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """line, exit_code of each command, run by the tasks. Only programs named in `allowed` run, without a
    shell; others get no exit code. Nothing is allowed unless the caller says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("line").to_pylist()
            words = [shlex.split(x or "") for x in lines]
            codes = [subprocess.run(w, capture_output=True).returncode if w and w[0] in allowed else None for w in words]
            yield pa.record_batch({"line": pa.array(lines, pa.string()), "exit_code": pa.array(codes, pa.int32())})

    return lines.select("line").mapInArrow(run, "line string, exit_code int")
