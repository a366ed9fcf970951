"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters and sorted by their normalised text; equal texts then
stand side by side, and each run of neighbours that are equal in full keeps its smallest identifier. The
order is that of a text's beginning, then of its hash, then of the whole text: so splitters are a few bytes
and may go to the driver, and texts that share a long beginning still spread over many ranges.

A run lies in one range, but for hot texts: those that would fill more than a partition, going by a bounded
sample, are cut into pieces by a hash of the identifier, one for each partition they would fill. Only the
heads of such pieces, about one for each partition at most, are compared once more; nothing else is grouped.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, materialized_from, named, partitions, table, text_digest, without

#: Characters of a splitter.
SPLITTER = 32
#: Rows sampled for each partition to find hot texts.
SAMPLED = 100
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def hot_texts(docs: DataFrame, text_col: str, n: int, sampled: int = SAMPLED) -> DataFrame:
    """hot_beginning, hot_hash and pieces of the texts that would fill more than one of n partitions, going
    by about `sampled` rows for each: fewer than n texts, of fewer than 2n pieces."""
    total = docs.count()
    texts = docs.select(named(text_col).alias("text"))
    few = texts.sample(sampled * n / total, 7) if total > sampled * n else texts
    share = max(1, min(total, sampled * n) // n)
    seen = few.select(normalised(F.col("text")).alias("content")).select(F.substring("content", 1, SPLITTER).alias("hot_beginning"), F.xxhash64("content").alias("hot_hash"))
    often = seen.groupBy("hot_beginning", "hot_hash").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") > share)
    return often.select("hot_beginning", "hot_hash", F.ceil(F.col("met") / share).cast("int").alias("pieces"))


def content_sorted(docs: DataFrame, id_col: str, text_col: str, n: int | None = None, raw: bool = False) -> DataFrame:
    """id, digest of the normalised text, hot (whether its text was cut into pieces), place in its run by
    identifier, least and members: the smallest identifier and the rows of the run; and raw, the digest of
    the text as it is, if asked for, by which rows of equal identifiers are ordered."""
    n = n or partitions(docs.sparkSession)
    extra = [text_digest(named(text_col)).alias("raw")] if raw else []
    rows = docs.select(named(id_col).alias("id"), normalised(named(text_col)).alias("content"), *extra)
    rows = rows.withColumns({"beginning": F.substring("content", 1, SPLITTER), "hash": F.xxhash64("content")})
    often = F.broadcast(materialize(hot_texts(docs, text_col, n), "hot-texts"))  # at most a few for each partition
    rows = rows.join(often, (F.col("beginning") == F.col("hot_beginning")) & (F.col("hash") == F.col("hot_hash")), "left")
    rows = rows.withColumns({"hot": F.col("pieces").isNotNull(), "piece": F.coalesce(F.pmod(F.xxhash64("id"), "pieces"), F.lit(0))})
    run = Window.partitionBy("beginning", "hash", "piece", "content").orderBy(F.col("id").asc_nulls_last(), *["raw" for _ in extra])
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.repartitionByRange(n, "beginning", "hash", "piece").select(
        "id",
        "hot",
        F.sha2("content", 256).alias("digest"),
        F.row_number().over(run).alias("place"),
        F.min("id").over(whole).alias("least"),
        F.count(F.lit(1)).over(whole).alias("members"),
        *["raw" for _ in extra],
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. n: partitions.

    Null and empty texts are one group. Null identifiers come after all others; a group of null
    identifiers has keep_id null. Of rows repeated with the same identifier exactly one is kept. An
    empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    runs = materialize(content_sorted(docs, id_col, text_col, n), "exact-dedup-runs")
    rows, keep = settled(runs)
    return rows.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("all_members", "members").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def settled(runs: DataFrame) -> tuple[DataFrame, Column]:
    """runs with the totals of hot texts, and the smallest identifier of each row's text."""
    heads = runs.filter("hot AND place = 1").groupBy("digest").agg(F.min("least").alias("all_least"), F.sum("members").alias("all_members"))
    rows = runs.join(F.broadcast(heads), "digest", "left")  # at most one for each hot text
    return rows, F.when(F.col("hot"), F.col("all_least")).otherwise(F.col("least"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """The rows of docs, all their columns, that exact_dedup keeps. The sort has told which ones go; documents
    are filtered by those.

    Rows that repeat both identifier and text are interchangeable for it; one of them stays.
    """

    def odd() -> DataFrame:
        rows, keep = settled(materialize(content_sorted(docs, id_col, text_col, n, raw=True), "exact-dedup-runs"))
        # an identifier lies in one piece of a text, so that exactly one first row has it
        kept = (F.col("place") == 1) & F.col("id").eqNullSafe(keep)
        rows = rows.select("id", F.col("raw").alias("digest"), kept.alias("kept"))
        gone = rows.filter("NOT kept").select("id", "digest").distinct()
        left = rows.filter("kept").select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest"))
        same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
        return gone.join(left, same, "left").select("id", "digest", F.col("kept_digest").isNotNull().alias("stays"))

    return without(docs, materialized_from(docs.sparkSession, odd, "not-kept"), id_col, text_col)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup of documents: null texts count as empty, null identifiers come last, repeated rows are
    all but one not kept, an empty table gives no rows."""
    return exact_dedup(table(spark, sf_dir, "documents"))

QUERIES = {"op5_exact_dedup": op5_exact_dedup}

ORACLES = {
    "op5_exact_dedup": """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT doc_id, content,
         min(doc_id) OVER (PARTITION BY content) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size,
         row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST) AS place
  FROM n
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM g
""",
}
