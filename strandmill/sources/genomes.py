"""Sequence tables: seq, ident, dna, len, g_off.

seq counts records from 0; g_off is where a record starts in the coordinates of the whole genome, in which
one separator stands between records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.dna import from_text, reverse_complement
from strandmill.operators.indexing import with_places
from strandmill.storage import saved, small


def genome(records: DataFrame, key: str | list[str], spot: str | None = None) -> DataFrame:
    """Numbers records (ident, dna and the numeric keys that order them; spot as in with_places); dna is
    upper-cased."""
    rows = records.withColumn("dna", F.upper("dna")).withColumn("len", F.length("dna").cast("bigint")).withColumn("__step", F.col("len") + 1)
    placed = with_places(rows, key, "__step", "seq", "g_off", spot)
    return placed.select("seq", F.col("ident").cast("string").alias("ident"), "dna", "len", "g_off")


def collection(records: DataFrame, name: str, keys: list[str], spot: str | None = None) -> DataFrame:
    """Numbers the records (ident, dna, keys; spot as in with_places) of each genome on their own; the genome's
    name stays as column genome. Genomes are numbered together, in the order of their names, and their
    first places taken off."""
    spot = spot or keys[0]
    names = records.select(F.col(name).alias("__genome")).distinct()
    names = names.withColumn("__rank", F.row_number().over(Window.partitionBy().orderBy("__genome")))  # a row for each genome
    # Few genomes' rows are sent to where the sequences lie, which else would travel for each of the two joins.
    rows = records.join(small(saved(names, "genomes")), F.col(name).eqNullSafe(F.col("__genome"))).drop("__genome")
    rows = rows.withColumn("dna", F.upper("dna")).withColumn("len", F.length("dna").cast("bigint")).withColumn("__step", F.col("len") + 1)
    span = rows.agg(F.min(spot), F.max(spot)).first()
    low, wide = float(span[0] or 0), float((span[1] or 0) - (span[0] or 0)) + 1
    rows = rows.withColumn("__spot", F.col("__rank") + F.coalesce((F.col(spot) - F.lit(low)) / F.lit(wide * 2), F.lit(0.0)))
    placed = with_places(rows, ["__rank", *keys], "__step", "seq", "g_off", "__spot")
    firsts = placed.groupBy("__rank").agg(F.min("seq").alias("__seq"), F.min("g_off").alias("__off"))
    return placed.join(small(saved(firsts, "firsts")), "__rank").select(F.col(name).alias("genome"), (F.col("seq") - F.col("__seq")).alias("seq"), F.col("ident").cast("string").alias("ident"), "dna", "len", (F.col("g_off") - F.col("__off")).alias("g_off"))


def text_genome(records: DataFrame, key: str, text: str, turned: Column | None = None) -> DataFrame:
    """The texts of a table as sequences, those for which `turned` holds reverse-complemented. Lengths
    come from the texts, which are smaller than their bases; the bases are made last."""
    size = (F.octet_length(F.coalesce(text, F.lit(""))) * 2).cast("bigint")
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"), size.alias("len"), (size + 1).alias("__step"), (F.lit(False) if turned is None else turned).alias("turned"))
    dna = from_text(F.col("text"))
    placed = with_places(rows, "key", "__step", "seq", "g_off")
    return placed.select("seq", F.col("key").cast("string").alias("ident"), F.when(F.col("turned"), reverse_complement(dna)).otherwise(dna).alias("dna"), "len", "g_off")


def documents_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_genome(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def documents_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of their sources, which are the genomes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collection(docs.select("source", "doc_id", F.col("doc_id").alias("ident"), from_text(F.col("text")).alias("dna")), "source", ["doc_id"])


def conversations_collection(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """Turns of conversations as records of n genomes; odd turns stand reverse-complemented, so that both
    strands have matches."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    dna = from_text(F.col("text"))
    dna = F.when(F.pmod("turn", F.lit(2)) == 1, reverse_complement(dna)).otherwise(dna)
    return collection(talks.select(F.pmod("conv_id", F.lit(n)).cast("string").alias("genome"), (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.concat_ws("-", "conv_id", "turn").alias("ident"), dna.alias("dna")), "genome", ["key"])


def benchmark_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with odd identifiers stand reverse-complemented, so that both strands have matches."""
    return text_genome(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", F.pmod("item_id", F.lit(2)) == 1)


def reversed_collection(sequences: DataFrame) -> DataFrame:
    """reversed_genome of each genome of a collection."""
    sizes = sequences.groupBy("genome").agg(F.count(F.lit(1)).alias("__n"), F.sum("len").alias("__bases"))
    rows = sequences.join(small(sizes), "genome")
    return rows.select("genome", (F.col("__n") - 1 - F.col("seq")).alias("seq"), "ident", reverse_complement(F.col("dna")).alias("dna"), "len", (F.col("__bases") + F.col("__n") - 1 - F.col("g_off") - F.col("len")).alias("g_off"))


def reversed_genome(sequences: DataFrame) -> DataFrame:
    """The other strand: each record reverse-complemented, the records in reverse order."""
    total = sequences.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("bases")).first()
    n, end = total["n"], total["bases"] + max(total["n"] - 1, 0)
    return sequences.select((F.lit(n) - 1 - F.col("seq")).alias("seq"), "ident", reverse_complement(F.col("dna")).alias("dna"), "len", (F.lit(end) - F.col("g_off") - F.col("len")).alias("g_off"))


def totals(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_length"))
