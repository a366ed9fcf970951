"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.sources.genomes import collection, genome
from strandmill.storage import saved, small


def fasta_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, place (a number that rises with the file names and offsets), block, row, ident and dna of the
    records. A record starts with > at the start of a line; its header goes to the end of that line, whatever
    else it holds, and ident is its first word. Only letters of the body count. What precedes a file's first record is
    passed over."""
    text = spark.read.option("lineSep", "\n>").text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    begins = F.min(F.when(F.col("block") == 0, F.col("row"))).alias("first")
    files = rows.groupBy("file").agg(begins)
    files = files.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("file")))  # a row for each file
    rows = rows.join(small(saved(files, "files")), "file")
    is_first = F.col("row") == F.col("first")
    rows = rows.filter(~is_first | F.col("value").startswith(">")).withColumn("value", F.when(is_first, F.expr("substring(value, 2)")).otherwise(F.col("value")))
    cut = F.instr("value", "\n")
    body = F.when(cut > 0, F.upper(F.regexp_replace(F.expr("substring(value, instr(value, '\\n'))"), "[^A-Za-z]", ""))).otherwise("")
    header = F.when(cut > 0, F.expr("substring(value, 1, instr(value, '\\n') - 1)")).otherwise(F.col("value"))
    place = F.col("rank") + F.least(F.col("block") / F.lit(float(1 << 50)), F.lit(0.5))
    return rows.select("file", place.alias("place"), "rank", "block", "row", F.regexp_extract(header, r"^\s*(\S*)", 1).alias("ident"), body.alias("dna"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequences of one or more FASTA files as one genome, in the order of file names and offsets."""
    return genome(fasta_rows(spark, path).drop("file"), ["rank", "block", "row"], spot="place")


def read_collection(spark: SparkSession, path: str | list[str], extension: str = "", by_folder: bool = False) -> DataFrame:
    """Sequences of the FASTA files of a folder, each file a genome of its own (column genome) called by the
    file's name without its extension; or, by_folder, each folder, called by what follows the last = in its
    name. extension: that of the files to be read, all if empty."""
    where = path if not extension else [f"{p.rstrip('/')}/*.{extension}" for p in ([path] if isinstance(path, str) else path)]
    rows = fasta_rows(spark, where)
    pattern = r"([^/=]*)/[^/]*$" if by_folder else r"([^/]*?)(?:\.[^./]*)?$"
    name = F.regexp_extract(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), pattern, 1)
    return collection(rows.withColumn("genome", name), "genome", ["rank", "block", "row"] if by_folder else ["block", "row"], "place" if by_folder else None)


def write_fasta(sequences: DataFrame, path: str, width: int | None = None, compression: str | None = None) -> None:
    """A header line and the bases of each record, in order of seq; on one line, or on lines of width. compression: as Spark's writer of text names it; a
    file that is compressed by gzip is one split, which holds whole records."""
    body = F.col("dna") if width is None else F.regexp_replace("dna", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.orderBy("seq").select(F.concat(F.lit(">"), "ident", F.lit("\n"), body)).write.text(path, compression=compression)


def write_fasta_chunks(chunked: DataFrame, path: str) -> None:
    """Records with a column chunk go to a folder of their chunk, each in order of seq."""
    rows = chunked.repartition("chunk").sortWithinPartitions("chunk", "seq")
    rows.select("chunk", F.concat(F.lit(">"), "ident", F.lit("\n"), "dna").alias("value")).write.partitionBy("chunk").text(path)
