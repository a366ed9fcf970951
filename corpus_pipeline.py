"""Corpus pipeline: quality filter, exact and near deduplication, source mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import bpe_tree, exact_dedup, mixing, near_jaccard, quality
from strandmill.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least the threshold. Null texts count as empty and are scored too, repeated rows each;
    without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text but for white space: that with the smallest identifier, nulls last. Null and
    empty texts are one text."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near duplicates, chosen likewise: SimHash balls, completed by a similarity
    join, as fingerprints alone miss most texts of similarity 0.8. Null and wordless texts are one group."""
    return near_jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows. Null sources and languages count as unknown, null texts as one token; rows of one
    identifier are drawn alike."""
    return mixing.mix(docs).filter("mixing.sampled").drop("mixing")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, and the tokens of each row; null texts have none."""
    coded = bpe_tree.encode_documents(docs.select("doc_id", "source", "lang", "text"))
    return coded.select("doc_id", "source", "lang", "bpe.*")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: The quality classifier and the near-duplicate stage can't be said in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder for the next. Extra columns of
    documents, whatever their names, go along up to the last stage; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
