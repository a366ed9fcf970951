"""Exact top-k inner products by best-first search in M-trees.

A vector x is given one more component, sqrt(M - |x|^2), M being the greatest squared length, and a query q a zero; then
|q - x|^2 = |q|^2 + M - 2 q.x, so that the nearest vectors are those with the highest scores, and distances obey
the triangle inequality. Rows go to the nearest of some sampled pivots. Each cluster, in parts of a bounded size, is an
M-tree of its own, stored as a table of pages: a page has a routing vector and a covering radius, and for each of its entries
(rows, or pages below) the distance to that routing vector, and for pages below their radii. A cluster's pivot and radius are the
entry above its trees.

A search goes twice over the clusters: each query first asks the nearest one, then, with the distance that it has by then, those
that may hold anything nearer. In a tree, queries walk together: the page with the smallest lower bound of any comes
first, each query drops out of a page, or of entries before their distances are computed, where its bound says so.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, materialized_from, partitions, table
from strandmill.llm.hard_negatives import first_few
from strandmill.llm.vectors import ids_of, inner, integer_rows, matrix

#: Rows of a leaf page and pages of an inner one; rows of a tree and queries that ask it at once, about.
LEAF, FANOUT, TREE, ASKING = 128, 16, 4_096, 2_048
#: Pivots at most; they are sent to all tasks.
MAX_PIVOTS = 1_024
#: Bounds are loosened by this share of the lengths, far above the rounding of distances.
SLACK = 1e-6
PAGES = "page int, leaf boolean, n int, routing array<bigint>, ids array<bigint>, vectors binary, distances array<double>, radii array<double>"


def apart(x: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """Distances of all rows of x and y with their additional components."""
    wx, wy = (np.sqrt(np.maximum(top - np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64)), 0)) for m in (x, y))
    return np.sqrt(np.maximum(2 * top - 2 * (inner(x, y) + np.outer(wx, wy)), 0))


def from_query(q: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """Distances of queries, whose additional component is zero, to vectors."""
    f = q.astype(np.float64)
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", f, f)[:, None] + top - 2.0 * inner(q, y), 0))


# building


def leaves(x: np.ndarray, top: float) -> list[np.ndarray]:
    """Row numbers in runs of at most LEAF near ones: each set is halved at the median of how much nearer its
    members are to one of two far ones; equal vectors are halved anyhow."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        a = own[np.argmax(apart(x[own[:1]], x[own], top)[0])]
        to_a = apart(x[a : a + 1], x[own], top)[0]
        b = own[np.argmax(to_a)]
        order = np.argsort(to_a - apart(x[b : b + 1], x[own], top)[0], kind="stable")
        half = len(own) // 2
        open_ += [own[order[half:]], own[order[:half]]]
    return out


def central(x: np.ndarray, top: float) -> int:
    """The row nearest to the mean direction."""
    return int(np.argmax(x @ x.mean(axis=0)))


def pages_of(ids: list[int | None], x: np.ndarray, top: float) -> list[tuple]:
    """The pages of a tree, children before their parent, the root last."""
    out: list[tuple] = []
    level = []  # page, routing vector, covering radius
    for own in leaves(x, top):
        routing = x[own[central(x[own], top)]]
        far = apart(routing[None], x[own], top)[0]
        out.append((len(out), True, len(own), routing, [ids[i] for i in own], np.ascontiguousarray(x[own]).tobytes(), far, None))
        level.append((len(out) - 1, routing, float(far.max())))
    while len(level) > 1:
        above = []
        for a in range(0, len(level), FANOUT):
            below = level[a : a + FANOUT]
            v, radii = np.stack([r for _, r, _ in below]), np.array([r for _, _, r in below])
            routing = v[central(v, top)]
            far = apart(routing[None], v, top)[0]
            out.append((len(out), False, len(below), routing, [p for p, _, _ in below], v.tobytes(), far, radii))
            above.append((len(out) - 1, routing, float((far + radii).max())))
        level = above
    return out


def build(top: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made = pages_of(rows["id"].to_pylist(), matrix(rows["x"]), top)
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        names = [c.split()[0] for c in PAGES.split(", ")]
        columns = {n: pa.array(list(c), k) for n, c, k in zip(names, zip(*made, strict=True), kinds, strict=True)}
        return pa.table({"cluster": pa.array([key[0].as_py()] * len(made), pa.int32()), "part": pa.array([key[1].as_py()] * len(made), pa.int32())} | columns)

    return run


# searching


class Tree:
    """The pages of one tree in memory."""

    def __init__(self, pages: pa.Table, top: float):
        self.top, self.computed = top, 0
        self.pages = {}
        for p in pages.to_pylist():
            v = np.frombuffer(p["vectors"], np.int64).reshape(p["n"], -1)
            self.pages[p["page"]] = (p["leaf"], np.array(p["routing"], np.int64), p["ids"], v, np.array(p["distances"]), p["radii"] and np.array(p["radii"]))
        self.root = max(self.pages)

    def search(self, q: np.ndarray, names: list[int | None], k: int, bound: np.ndarray) -> list[list[tuple[int, int | None]]]:
        """For each query its k best (score, identifier) or fewer, best first, but none with its own identifier (names), and
        none surely farther than its bound (a distance)."""
        lengths = np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))
        slack = SLACK * (np.sqrt(self.top) + np.sqrt(lengths) + 1)
        best: list[list[tuple]] = [[] for _ in q]
        least = np.full(len(q), np.iinfo(np.int64).min)  # the k-th score so far
        reach = bound + slack
        every = np.arange(len(q))
        queue = [(0.0, self.root, every, np.zeros(len(q)), from_query(q, self.pages[self.root][1][None], self.top)[:, 0])]
        while queue:
            _, page, own, lower, to_routing = heapq.heappop(queue)
            alive = lower <= reach[own]
            own, to_routing = own[alive], to_routing[alive]
            leaf, _, ids, v, far, radii = self.pages[page]
            around = np.abs(to_routing[:, None] - far) - (0 if leaf else radii)
            near = around <= reach[own][:, None]  # stored distances alone
            some, entries = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            asked = own[some]
            self.computed += len(asked) * len(entries)
            if leaf:
                scores = inner(q[asked], v[entries])
                hopeful = scores >= least[asked][:, None]
                for i in np.flatnonzero(hopeful.any(axis=1)):
                    a = asked[i]
                    found = [(int(scores[i, j]), ids[entries[j]]) for j in np.flatnonzero(hopeful[i])]
                    met = best[a] + [(s, e) for s, e in found if e is None or e != names[a]]
                    best[a] = sorted(met, key=lambda t: (-t[0], t[1] is None, t[1]))[:k]
                    if len(best[a]) == k:
                        least[a] = best[a][-1][0]
                        reach[a] = min(reach[a], np.sqrt(max(lengths[a] + self.top - 2.0 * least[a], 0)) + slack[a])
                continue
            to_entries = from_query(q[asked], v[entries], self.top)
            for j, e in enumerate(entries):
                bounds = np.maximum(to_entries[:, j] - radii[e], 0)
                inside = near[some, e] & (bounds <= reach[asked])
                if inside.any():
                    heapq.heappush(queue, (float(bounds[inside].min()), ids[e], asked[inside], bounds[inside], to_entries[inside, j]))
        return best


def searched(k: int, top: float):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        rows = []
        if len(pages) and len(queries):
            best = Tree(pages, top).search(matrix(queries["x"]), queries["id"].to_pylist(), k, queries["bound"].to_numpy())
            rows = [(u, score, i) for u, own in zip(queries["uid"].to_pylist(), best, strict=True) for score, i in own]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("uid", "score", "found"), zip(*rows, strict=True) if rows else [()] * 3, strict=True)})

    return run


def pivots_of(rows: DataFrame, n: int) -> np.ndarray:
    """Vectors of the rows with the smallest hashes, each once: one for each TREE rows, MAX_PIVOTS at most."""
    few = rows.orderBy(F.xxhash64("uid"), "uid").limit(min(MAX_PIVOTS, max(1, -(-n // TREE)))).select("x").toArrow()
    return np.unique(matrix(few["x"]), axis=0)


def nearest(pivots: np.ndarray, top: float, x: Column) -> Column:
    """Struct of cluster, the nearest pivot, and far, the distance to it."""

    @F.arrow_udf("struct<cluster:int,far:double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            d = apart(matrix(batch, pivots.shape[1]), pivots, top)
            at = d.argmin(axis=1)
            yield pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at])], ["cluster", "far"])

    return place(x)


def visited(pivots: np.ndarray, radii: np.ndarray, top: float, x: Column, bound: Column | None = None) -> Column:
    """The cluster whose pivot is nearest, or, given a bound, all others that may hold a vector within it."""

    @F.arrow_udf("array<int>")
    def home(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[c] for c in from_query(matrix(batch, pivots.shape[1]), pivots, top).argmin(axis=1).tolist()], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def others(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, bounds in batches:
            q = matrix(vectors, pivots.shape[1])
            d = from_query(q, pivots, top)
            slack = SLACK * (np.sqrt(top) + np.sqrt(np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))) + 1)
            may = d - radii <= (bounds.to_numpy(zero_copy_only=False) + slack)[:, None]
            may[np.arange(len(d)), d.argmin(axis=1)] = False
            yield pa.array([np.flatnonzero(m).tolist() for m in may], pa.list_(pa.int32()))

    return home(x) if bound is None else others(x, bound)


def ask(pages: DataFrame, sizes: DataFrame, visits: DataFrame, k: int, top: float) -> DataFrame:
    """uid, score, found for each query of visits (uid, id, x, bound, cluster) and each part of the cluster: queries
    of a cluster come in chunks, and each chunk meets each part in a cell of its own. sizes: cluster, parts."""
    visits = materialize(visits.join(F.broadcast(sizes), "cluster"), "visits")  # a row for each pivot
    chunks = visits.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("chunks"))
    chunks = F.broadcast(chunks)  # likewise
    share = F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")
    queries = visits.join(chunks, "cluster").select("cluster", share.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "uid", "id", "x", "bound")
    trees = pages.join(chunks, "cluster").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).drop("chunks")
    cell = ("cluster", "part", "chunk")
    return trees.groupBy(*cell).cogroup(queries.toDF(*queries.columns).groupBy(*cell)).applyInArrow(searched(k, top), "uid bigint, score bigint, found bigint")


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k highest inner products of its integer vector with those of all other
    rows, ties to smaller identifiers, null ones last.

    Queries are the rows for which is_query holds. Rows that integer_rows leaves out take no part. Rows of the
    query's identifier are no candidates; other rows count each, repeated ones too, and a repeated query has its result as
    often. Queries with fewer candidates get those; without candidates or queries there is no result. Only the columns named are read.
    """
    rows = materialize(integer_rows(df, id_col, vector_col, factor, F.coalesce(is_query, F.lit(False)).alias("query")), "vectors")
    n, top = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    pivots = pivots_of(rows, n)
    placed = materialize(rows.withColumn("p", nearest(pivots, top, F.col("x"))).select("uid", "id", "x", "query", "p.*"), "placed")
    clusters = placed.groupBy("cluster").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("parts"))
    clusters = materialize(clusters, "clusters")
    spread = max(1, -(-partitions(df.sparkSession) // max(len(pivots), 1))) if n >= LEAF * partitions(df.sparkSession) else 1
    sizes = clusters.select("cluster", (F.col("parts") * spread).alias("parts"))
    radii = np.full(len(pivots), -np.inf)
    for r in clusters.select("cluster", "radius").collect():  # a row for each pivot
        radii[r.cluster] = r.radius

    part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(sizes), "cluster").select("cluster", part.alias("part"), "id", "x")
    pages = materialize(dealt.groupBy("cluster", "part").applyInArrow(build(top), f"cluster int, part int, {PAGES}"), "pages")
    queries = placed.filter("query").select("uid", "id", "x")
    unbound = F.lit(float("inf")).alias("bound")
    at_home = queries.select("*", unbound, F.explode(visited(pivots, radii, top, F.col("x"))).alias("cluster"))
    near = materialized_from(df.sparkSession, lambda: first_few(ask(pages, sizes, at_home, k, top), ["uid"], "score", "found", k, "rank"), "near")
    worst = near.filter(F.col("rank") == k).select(F.col("uid").alias("met"), F.col("score").alias("worst"))
    length = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    bound = F.when(F.col("worst").isNotNull(), F.sqrt(F.greatest(length + F.lit(float(top)) - 2.0 * F.col("worst"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    bounded = queries.join(worst, F.col("uid") == F.col("met"), "left").select("uid", "id", "x", bound.alias("bound"))
    beyond = bounded.select("*", F.explode(visited(pivots, radii, top, F.col("x"), F.col("bound"))).alias("cluster"))
    best = first_few(near.select("uid", "score", "found").union(ask(pages, sizes, beyond, k, top)), ["uid"], "score", "found", k, "rank")
    return best.join(queries.select(F.col("uid").alias("own"), F.col("id").alias("query_id")), F.col("uid") == F.col("own")).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score")


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k of embeddings for each fiftieth identifier; edge cases are those of top_k."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id) QUALIFY rank <= 5"""

QUERIES = {"op12_exact_search": op12_exact_search}
ORACLES = {"op12_exact_search": SQL}
