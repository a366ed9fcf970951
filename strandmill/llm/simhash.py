"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all 64-bit values within half the link radius. Two fingerprints are
within the radius exactly when they share such a value, and all that share one are within the radius of
each other, so a value links its fingerprints to the smallest of them: no pairs are enumerated, and the
links span the same components. A value is shared by at most as many fingerprints as a ball has members
(65 at radius 2), whatever the data. Components are found by alternating large-star and small-star
steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, materialized_from, named, partitions, pieces, table, text_digest, without

SEED = 42
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence if it is shorter."""
    tokens = text.lower().split()  # of bytes: A-Z only; white space is 0x20, 0x09-0x0D
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles; 0 without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[i : i + BLOCK], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(x or b"", words) for part in pieces(pc.cast(batch, pa.binary())) for x in part.to_pylist()], pa.int64())

    return simhash(text)


def ball(radius: int) -> list[int]:
    """Signed masks that flip up to `radius` of 64 bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a < b, at most radius bits apart, that span the components of all such links.
    prints: distinct values in column fp. They are dealt out first: a few MB become many times as much."""
    if radius % 2:
        raise ValueError("the radius must be even: balls of half the radius meet in the middle")
    masks = F.explode(F.array(*[F.lit(m).cast("bigint") for m in ball(radius // 2)]))
    dealt = prints.repartition(partitions(prints.sparkSession), "fp")
    variants = dealt.select("fp", masks.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("a", F.min("fp").over(Window.partitionBy("variant"))).filter("a <> fp")
    return met.select("a", F.col("fp").alias("b")).filter(F.expr(f"bit_count(a ^ b) <= {radius}")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node of its component.

    Large-star hangs the larger neighbours of each node on its smallest one, small-star the smaller
    ones; the edges become stars after a number of rounds that is logarithmic in practice. Minima are
    pre-aggregated before the shuffle, and the join of edges with minima is left to adaptive execution,
    which splits the partition of a hub.
    """
    return materialized_from(links.sparkSession, lambda: _stars(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "components")


def _stars(links: DataFrame) -> DataFrame:
    edges = materialize(links.filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(hung.union(small).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now


def print_roots(rows: DataFrame, radius: int) -> DataFrame:
    """fp, root, least (identifier) and members for each distinct fp of rows (id, fp)."""
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"))
    roots = components(ball_links(prints.select("fp"), radius))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "members", F.coalesce("root", "fp").alias("root"))
    return materialize(placed, "placed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id, component_size.

    component_id is the smallest identifier that links reach, the row's own included. Null and wordless
    texts have fingerprint zero and link like any other; texts shorter than a shingle are one shingle.
    Null identifiers never become a component_id unless a component has no other. Repeated rows give
    repeated rows; an empty table gives none; other columns of docs are not read.
    """
    rows = materialize(docs.select(named(id_col).alias("id"), fingerprint_column(named(text_col), words).alias("fp")), "fingerprints")
    placed = print_roots(rows, radius)
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("members").alias("component_size"))
    by_print = placed.select("fp", "root").join(whole, "root").select("fp", "component_id", "component_size")
    return rows.join(by_print, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def one_for_each_root(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs, all its columns, for each root of rows (id, digest, root): the one with the
    smallest identifier, nulls last, and of those the one with the smallest text digest.

    Narrow rows decide which (id, digest) go.
    """
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("best")).select(F.col("root").alias("r"), F.col("best.id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    told = rows.groupBy("id", "digest", "root").agg(F.count(F.lit(1)).alias("n")).join(best, F.col("root") == F.col("r"))
    stays = F.col("id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest"))
    odd = materialize(told.filter(~stays | (F.col("n") > 1)).select("id", "digest", stays.alias("stays")), "not-kept")
    return without(docs, odd, id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row of docs, all its columns, for each component, chosen as one_for_each_root says."""
    text = named(text_col)
    rows = materialize(docs.select(named(id_col).alias("id"), text_digest(text).alias("digest"), fingerprint_column(text, words).alias("fp")), "fingerprints")
    roots = print_roots(rows, radius).select("fp", "root")
    return one_for_each_root(docs, rows.join(roots, "fp").select("id", "digest", "root"), id_col, text_col)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents: null and wordless texts link like any other, null identifiers never
    name a component that has another, repeated rows stay repeated, an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
