"""Hard negatives by a full sort of each anchor's scores.

Rows are dealt into blocks and anchors into chunks, by hashes of row numbers, so that neither a label nor an identifier
makes a block larger. Each cell, one block and one chunk, holds the integer scores of its anchors against its rows,
sorted by score and identifier. A first round reads each anchor's positives off the sorted scores; a second finds the
upper limit of each positive in them by binary search and reads the different-label entries from there to the lower
limit. Of each cell a few entries leave, and Spark ranks those of all cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, named, partitions, table
from strandmill.llm.vectors import ids_of, inner, integer_rows, matrix

#: Rows of a block and anchors of a chunk, about; anchors whose scores a task holds at a time.
ROWS, ANCHORS, AT_ONCE = 16_384, 4_096, 64


def sorted_scores(rows: pa.Table, anchors: pa.Table):
    """For each anchor (a row number of anchors): the scores in falling order, ties by smaller identifier, nulls last, and the
    places of the rows in that order."""
    x, (ids, missing) = matrix(rows["x"]), ids_of(rows["id"])
    for a in range(0, len(anchors), AT_ONCE):
        scores = inner(matrix(anchors["x"].slice(a, AT_ONCE)), x)
        keys = (np.broadcast_to(ids, scores.shape), np.broadcast_to(missing, scores.shape), -scores)
        for i, order in enumerate(np.lexsort(keys, axis=-1)):
            yield a + i, scores[i][order], order


def cells(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run for each block of rows and each chunk of anchors; both have a column uid."""

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        share = F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
        return df.toDF(*df.columns).withColumn(own, share).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    a = dealt(rows, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    b = dealt(anchors, "chunk", chunks, "block", blocks).groupBy("block", "chunk")
    return a.cogroup(b).applyInArrow(run, schema)


def _positives(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        labels, (ids, missing) = rows["label"].to_numpy(), ids_of(rows["id"])
        own_labels, uids, (own_ids, nameless) = anchors["label"].to_numpy(), anchors["uid"].to_numpy(), ids_of(anchors["id"])
        out = []
        for i, scores, order in sorted_scores(rows, anchors):
            same = (labels[order] == own_labels[i]) & ((ids[order] != own_ids[i]) | missing[order] | nameless[i])
            out += [(uids[i], None if missing[order[k]] else ids[order[k]], scores[k]) for k in np.flatnonzero(same)[:most]]
        return _table(out, "anchor", "positive_id", "positive_score")

    return run


def _negatives(most: int, lower: int, upper: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        labels, (ids, missing) = rows["label"].to_numpy(), ids_of(rows["id"])
        own_labels, uids, positives = anchors["label"].to_numpy(), anchors["uid"].to_numpy(), anchors["positives"].to_pylist()
        out = []
        for i, scores, order in sorted_scores(rows, anchors):
            other = np.flatnonzero(labels[order] != own_labels[i])
            falling = -scores[other]
            for p in positives[i]:
                # lower * positive <= 100 * negative <= upper * positive, in Python's whole numbers
                least, greatest = -(-lower * p["positive_score"] // 100), upper * p["positive_score"] // 100
                if least > greatest:
                    continue
                first, end = np.searchsorted(falling, -greatest, "left"), np.searchsorted(falling, -least, "right")
                out += [(uids[i], p["place"], None if missing[order[k]] else ids[order[k]], scores[k]) for k in other[first : min(end, first + most)]]
        return _table(out, "anchor", "place", "negative_id", "negative_score")

    return run


def _table(rows: list[tuple], *names: str) -> pa.Table:
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)})


def first_few(df: DataFrame, by: list[str], score: str, identifier: str, most: int, rank: str) -> DataFrame:
    """Spark drops what can't be among the first ones before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(identifier).asc_nulls_last())
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, factor: int = 256, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label take no part, nor do those that integer_rows leaves out; each other row counts, repeated ones
    too. Anchors are the rows for which is_anchor holds. An anchor's positives are the first rows of its label that have
    not its identifier; the negatives of a positive are the first rows of another label, whatever their identifier, with
    lower * positive_score <= 100 * negative_score <= upper * positive_score. First is the higher score, then the
    smaller identifier, null ones last. So a negative positive score has no negatives. Without rows, anchors or
    positives there is no result.
    """
    label = named("label") if label is None else label
    rows = integer_rows(df, id_col, vector_col, factor, label.cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialize(rows.filter(F.col("label").isNotNull()).drop("norm"), "labelled-vectors")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    blocks = max(-(-n // ROWS), min(partitions(df.sparkSession), n), 1)
    chunks = max(-(-n_anchors // ANCHORS), 1)
    every, own = rows.select("uid", "id", "label", "x"), rows.filter("anchor").select("uid", "id", "label", "x")

    found = cells(every, own, blocks, chunks, _positives(positives), "anchor bigint, positive_id bigint, positive_score bigint")
    best = materialize(first_few(found, ["anchor"], "positive_score", "positive_id", positives, "place").withColumn("place", F.col("place").cast("bigint")), "positives")
    lists = best.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_score")).alias("positives"))  # a few for each anchor
    asked = own.join(lists, F.col("uid") == F.col("anchor")).select("uid", "label", "x", "positives")
    found = cells(every, asked, blocks, chunks, _negatives(negatives, lower, upper), "anchor bigint, place bigint, negative_id bigint, negative_score bigint")
    ranked = first_few(found, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    told = ranked.join(best, ["anchor", "place"]).join(own.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hard_negatives of embeddings, with each hundredth identifier as anchor; identifiers divisible by 7 bear the next
    label. Edge cases are those of hard_negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": SQL}
