"""Near-duplicates by true similarity: texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more, and whatever chains of such links reach.

The first candidates come from SimHash balls, as in simhash.py; but 64 bits can't promise a similarity, so
more come from prefix filtering, which misses none: if shingles have one order for all texts, two similar
texts share one of the first n - ceil(0.8 n) + 1 of their n. The order puts shingles of rarely met hash
buckets first, so that common lines and passages are seldom among them; it decides the cost only. A shingle
first links its texts to one of them, then, if it has many, to a few others at random, in numbers linear in its texts; then only
pairs are made that lie in different components so far. Candidates are first held against the bound that both whole prefixes give, and
then verified on both whole sets, for which only those texts are fetched. Shingles are compared by their XXH64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import few, lean, materialize, materialized_from, named, pieces, text_digest
from strandmill.llm.simhash import ball_links, components, fingerprint_of, one_for_each_root, shingle_hashes

#: Words of a shingle; bits at which fingerprints give candidates.
WORDS, RADIUS = 5, 2
#: Counters of shingle hashes; their table goes to the driver and to tasks, whatever the input's size.
BUCKETS = 1 << 16
#: Texts sampled to find shingles that many prefixes share, and how many of them make a shingle hot.
SAMPLED, HOT = 20_000, 20
#: Nodes of a shingle that are compared pair by pair at once.
CROWD = 8
#: Bits of a set's parities.
PARITIES = 512
#: Shingles before its own that each member of a pair shows to tell that the pair has met before.
RECENT = 32


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, sorted. Texts shorter than a shingle are one; those without words have none."""
    return np.unique(shingle_hashes(text or b"", words))


def bucket_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many shingles of all sets fall into each of BUCKETS, by hash."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in pieces(pc.cast(batch.column(0), pa.binary())):
                hashes = np.concatenate([shingle_set(x, words) for x in piece.to_pylist()])
                total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(named(text_col)).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each of PARITIES classes of hashes has an odd number of members, as bits of longs. Classes in which two sets
    differ hold at least one member each that the sets don't share."""
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def near_enough(a: str = "parities_a", b: str = "parities_b", n: str = "n_a + n_b") -> Column:
    """Whether sets with so many different parities can have a Jaccard similarity of 0.8: of two with d members that they don't
    share it is (n - d) / (n + d)."""
    apart = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(PARITIES // 64))
    return F.expr(f"9 * ({apart}) <= {n}")


def prefix_length(n: int) -> int:
    """So many first shingles of n, that any set with a similarity of 0.8 or more has one of them."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def prefixes(text: Column, counts: np.ndarray, words: int) -> Column:
    """Struct of signature (of the set), n (its size), fp (SimHash), prefix, last: where in the order of
    all shingles the prefix ends, and parities."""
    last = pa.struct([("met", pa.int64()), ("hash", pa.int64())])
    names = [("signature", pa.string()), ("n", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64())), ("last", last), ("parities", pa.list_(pa.int64()))]

    @F.arrow_udf("struct<signature:string,n:int,fp:bigint,prefix:array<bigint>,last:struct<met:bigint,hash:bigint>,parities:array<bigint>>")
    @lean
    def prefix(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in (x for part in pieces(pc.cast(batch, pa.binary())) for x in part.to_pylist()):
                hashes = shingle_hashes(x or b"", words)
                found = np.unique(hashes)
                met = counts[(found % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((found, met))[: prefix_length(len(found))]
                end = {"met": int(met[order[-1]]), "hash": int(found[order[-1]]) - (1 << 63)} if len(order) else {"met": -1, "hash": 0}
                rows.append((hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest(), len(found), fingerprint_of(hashes), found[order].view(np.int64), end, parities(found)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, names, strict=True)], [name for name, _ in names])

    return prefix(text)


def set_column(text: Column, words: int) -> Column:
    @F.arrow_udf("array<bigint>")
    @lean
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(x, words) for part in pieces(pc.cast(batch, pa.binary())) for x in part.to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))

    return shingles(text)


def reachable(na: str, nb: str, shared: str) -> Column:
    """Whether sets of na and nb members of which at most (or just) so many are shared have a Jaccard similarity of 0.8 or more."""
    return F.expr(f"9 * ({shared}) >= 4 * ({na} + {nb})")


def of_both(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of both nodes, called c_a and c_b. nodes: node and others."""
    a, b = (nodes.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in nodes.columns]) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def among(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that pairs name."""
    asked = materialize(pairs.select(F.col("a").alias("asked")).union(pairs.select("b")).distinct(), "asked")
    return nodes.join(few(asked), F.col("node") == F.col("asked"), "left_semi")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar.

    Whichever prefix ends first holds all of its set's shingles up to there, and so does the other prefix; so
    what the sets share is at most what the prefixes share and the rest of that set. For this bound half of
    a hash will do: if it makes different shingles equal, the bound is only higher.
    """
    pairs = materialize(pairs.filter("a < b").distinct(), "candidates")
    short = F.transform("prefix", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix")
    both = of_both(pairs, among(rows, pairs).select("node", "n", "last", F.size("prefix").alias("p"), short))
    both = both.withColumn("c", F.size(F.array_intersect("prefix_a", "prefix_b")) + F.col("p_a") - F.size(F.array_distinct("prefix_a")))
    bound = F.col("c") + F.when(F.col("last_a") <= F.col("last_b"), F.least(F.expr("n_a - p_a"), F.expr("n_b - c"))).otherwise(F.least(F.expr("n_b - p_b"), F.expr("n_a - c")))
    pairs = materialize(both.withColumn("bound", bound).filter(reachable("n_a", "n_b", "bound")).select("a", "b"), "candidates")

    needed = materialize(among(rows, pairs).select("node", F.col("digest").alias("needed")), "needed")
    texts = docs.select(text_digest(named(text_col)).alias("digest"), named(text_col).alias("text"))
    texts = texts.join(few(needed.select("needed")), F.col("digest") == F.col("needed"), "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    sets = materialize(texts.join(needed, F.col("digest") == F.col("needed")).select("node", set_column(F.col("text"), words).alias("set")), "shingle-sets")
    return of_both(pairs, sets).filter(reachable("size(set_a)", "size(set_b)", "size(array_intersect(set_a, set_b))")).select("a", "b")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) from fingerprints: all nodes of a fingerprint with the first of them, and the first
    ones of fingerprints that ball hashing links."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = nodes.join(firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of_a, of_b = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    linked = ball_links(firsts.select("fp"), RADIUS).join(of_a, "a").join(of_b, "b").select("first_a", "first_b")
    return equal.union(linked.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """node, n, pos, shingle, head (node, n, pos of the shingle's first node) for each shingle that several
    prefixes share. nodes: node, n, prefix.

    The nodes of a shingle are brought together, but for hot shingles, which a bounded sample tells: for those heads
    are pre-aggregated and joined back, which may split them.
    """
    total = nodes.count()
    some = nodes.sample(SAMPLED / total, 7) if total > SAMPLED else nodes
    often = some.select(F.explode("prefix").alias("often")).groupBy("often").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= HOT)
    often = F.broadcast(materialize(often.select("often"), "hot-shingles"))  # bounded by the sample
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    is_hot = F.col("shingle") == F.col("often")
    group = Window.partitionBy("shingle")
    head = F.min(F.struct("node", "n", "pos"))
    cold = postings.join(often, is_hot, "left_anti").withColumns({"head": head.over(group), "last": F.max("node").over(group)})
    hot = postings.join(often, is_hot, "left_semi")
    heads = hot.groupBy("shingle").agg(head.alias("head"), F.max("node").alias("last"))
    columns = ["node", "n", "pos", "shingle", "head"]
    return cold.filter("head.node < last").select(*columns).union(hot.join(heads, "shingle").filter("head.node < last").select(*columns))


def still_open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Of node, n, pos, shingle those rows whose shingle has nodes of different components of the links so far; with root, and members, the
    number of the shingle's rows."""
    roots = few(components(links).select(F.col("node").alias("own"), "root"))
    rows = shared.join(roots, F.col("node") == F.col("own"), "left").withColumn("root", F.coalesce("root", "node")).drop("own")
    split = rows.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members")).filter("x < y")
    return materialize(rows.join(split.select("shingle", "members"), "shingle"), "open-shingles")


def some_pairs(open_: DataFrame) -> DataFrame:
    """Candidates (a, b) of shingles with many nodes: these are dealt into groups of some four at random, twice, and each of a group goes
    with its smallest. Texts that are similar to many others are linked by these few pairs, and needn't be compared with all."""
    many = open_.filter(F.col("members") > CROWD).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    many = many.withColumn("group", F.pmod(F.xxhash64("shingle", "node", "turn"), F.ceil(F.col("members") / 4)))
    heads = many.groupBy("shingle", "turn", "group").agg(F.min(F.struct("node", "n", "pos", "root")).alias("head"))
    met = many.join(heads, ["shingle", "turn", "group"]).filter("root <> head.root").filter(reachable("n", "head.n", "least(n - pos, head.n - head.pos)"))
    return met.select(F.col("head.node").alias("a"), F.col("node").alias("b"))


def similar_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id, digest of the text, root of its component; written, all else being deleted."""
    return materialized_from(docs.sparkSession, lambda: _similar_roots(docs, id_col, text_col, words), "similar-roots")


def _similar_roots(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    spark, text = docs.sparkSession, named(text_col)
    counts = bucket_counts(docs, text_col, words)
    rows = docs.select(named(id_col).alias("id"), text_digest(text).alias("digest"), prefixes(text, counts, words).alias("p")).select("id", "digest", "p.*")
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()), "shingle-prefixes")
    # Texts of equal signature have equal sets: the first one stands for all.
    firsts = rows.groupBy("signature").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("signature", "first")
    copies = materialize(rows.select("signature", "node").join(firsts, "signature").filter("node > first").select(F.col("node").alias("copy"), "first"), "copies")
    nodes = rows.join(few(copies.select("copy")), F.col("node") == F.col("copy"), "left_anti")
    shared = materialize(shared_shingles(nodes.select("node", "n", "prefix")), "shared-shingles")

    stars = shared.filter("node > head.node").filter(reachable("n", "head.n", "least(n - pos, head.n - head.pos)"))
    stars = stars.select(F.col("head.node").alias("a"), F.col("node").alias("b")).union(print_pairs(nodes.select("node", "fp")))
    first = materialized_from(spark, lambda: verified(stars, rows, docs, text_col, words), "similar")
    near = materialized_from(spark, lambda: verified(some_pairs(still_open(shared.drop("head"), first)), rows, docs, text_col, words), "similar")
    similar = first.union(near)
    open_ = still_open(shared.drop("head"), similar)
    # Members of a group share most shingles: a pair is made at the first one, where the bound is lowest. At another one it is
    # dropped if one of the few before it, in the order that all prefixes have, is common too. Most members of a group of copies with
    # many changes each aren't similar; their parities tell so before a pair is made.
    recent = Window.partitionBy("node").orderBy("pos").rowsBetween(-RECENT, -1)
    open_ = open_.withColumn("recent", F.collect_list("shingle").over(recent))
    open_ = open_.join(nodes.select("node", "parities"), "node")
    a, b = (open_.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "root", "recent", "parities")]) for x in "ab")
    met = a.join(b, "shingle").filter("node_a < node_b AND root_a <> root_b").filter(reachable("n_a", "n_b", "least(n_a - pos_a, n_b - pos_b)"))
    met = met.filter(near_enough()).filter(~F.arrays_overlap("recent_a", "recent_b"))
    met = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    second = materialized_from(spark, lambda: verified(met, rows, docs, text_col, words), "similar")

    roots = components(similar.union(second)).select(F.col("node").alias("own"), "root")
    own = rows.select("id", "digest", "node").join(copies, F.col("node") == F.col("copy"), "left").select("id", "digest", F.coalesce("first", "node").alias("node"))
    return own.join(roots, F.col("node") == F.col("own"), "left").select("id", "digest", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of docs, all its columns, for each component of similar texts: that with the smallest
    identifier, nulls last. Null and wordless texts are one component; an empty table gives none."""
    return one_for_each_root(docs, similar_roots(docs, id_col, text_col, words), id_col, text_col)
