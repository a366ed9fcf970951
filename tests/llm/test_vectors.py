"""Hard negatives, exact search and whitening against slow plain versions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, connect, same
from pyspark.sql import functions as F

from strandmill.llm import hard_negatives, metric_tree, vectors, whitening

NAN, INF = float("nan"), float("inf")
CLASHES = ["id", "x", "norm", "uid", "block", "chunk", "place", "rank", "cluster", "part", "far", "query", "bound", "score", "anchor", "positives", "deviation", "component", "n", "w", "a.b"]


def table_of(spark, rows):
    """Rows (vec_id, embedding, label), and columns of the names that operators use inside."""
    more = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in rows], f"vec_id bigint, embedding array<double>, label int, {more}")


def mixed_rows(n=420, dims=6, seed=5):
    """Few different values, so that scores tie; a third of the rows hold one vector; odd rows of every kind."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, dims) / 4).tolist() if i % 3 else [0.5] * dims, int(rng.integers(0, 4))) for i in range(n)]
    odd = [(1000, None, 1), (1100, [None, 1.0], 1), (1200, [NAN] * dims, 1), (1300, [INF] * dims, 2), (1400, [0.25], 2), (1500, [], 3), (1600, [0.5] * dims, None), (None, [0.75] * dims, 1), (1700, [1e30] * dims, 1)]
    return rows + odd + [rows[100], rows[100], (-700, [-1.0] * dims, 0)]


def used(rows):
    """(row number, id, whole vector, label) of the rows that take part."""
    out = []
    for k, (i, v, label) in enumerate(rows):
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(c * c for c in x) < 1 << 62:
            out.append((k, i, x, label))
    return out


def score(x, y):
    return sum(a * b for a, b in zip(x, y, strict=False))


def order(t):
    return -t[0], t[1] is None, t[1] or 0


def slow_top(rows, step, k):
    out = []
    for _, i, x, _ in used(rows):
        if i is not None and i % step == 0:
            met = sorted(((score(x, y), j) for _, j, y, _ in used(rows) if j != i), key=order)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(met)]
    return sorted(map(str, out))


def slow_negatives(rows, step, positives, negatives, lower):
    rows = [(k, i, x, (c + 1) % 10 if i is not None and i % 7 == 0 else c) for k, i, x, c in used(rows) if c is not None]
    out = []
    for _, i, x, label in rows:
        if i is None or i % step:
            continue
        own = sorted(((score(x, y), j) for _, j, y, c in rows if c == label and j != i), key=order)[:positives]
        others = sorted(((score(x, y), j) for _, j, y, c in rows if c != label), key=order)
        for s, p in own:
            fit = [(t, j) for t, j in others if lower * s <= 100 * t <= 100 * s][:negatives]
            out += [(i, p, r + 1, j, s, t) for r, (t, j) in enumerate(fit)]
    return sorted(map(str, out))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize(("rows", "anchors", "at_once"), [(16_384, 4_096, 64), (50, 7, 3)])
def test_hard_negatives(spark, monkeypatch, rows, anchors, at_once):
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("AT_ONCE", at_once)):
        monkeypatch.setattr(hard_negatives, name, value)
    data = mixed_rows()
    found = hard_negatives.hard_negatives(table_of(spark, data), F.col("vec_id") % 20 == 0, label=label())
    assert told(found) == slow_negatives(data, 20, 5, 5, 80)


def test_hard_negatives_of_other_limits(spark):
    data = mixed_rows(150)
    found = hard_negatives.hard_negatives(table_of(spark, data), F.col("vec_id") % 10 == 0, label=label(), positives=2, negatives=9, lower=-100)
    assert told(found) == slow_negatives(data, 10, 2, 9, -100)


@pytest.mark.parametrize(("leaf", "fanout", "tree", "asking"), [(128, 16, 4_096, 2_048), (4, 2, 40, 5)])
def test_search(spark, monkeypatch, leaf, fanout, tree, asking):
    for name, value in (("LEAF", leaf), ("FANOUT", fanout), ("TREE", tree), ("ASKING", asking)):
        monkeypatch.setattr(metric_tree, name, value)
    data = mixed_rows()
    for k in (1, 5, 1000):
        assert told(metric_tree.top_k(table_of(spark, data), F.col("vec_id") % 50 == 0, k=k)) == slow_top(data, 50, k), k


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [2.0], 2)], [(0, [], 1), (50, [], 2), (100, [], 2)]])
def test_few_rows(spark, rows):
    df = table_of(spark, rows).select("vec_id", "embedding", "label")
    assert told(metric_tree.top_k(df, F.col("vec_id") % 50 == 0)) == slow_top(rows, 50, 5)
    assert told(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label=label())) == slow_negatives(rows, 100, 5, 5, 80)
    assert whitening.whitened(df).filter("whitened IS NULL").count() == 0


def test_a_tree_computes_few_distances_where_rows_lie_in_groups(monkeypatch):
    """Stored distances spare most rows, and no result is lost."""
    monkeypatch.setattr(metric_tree, "LEAF", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 8)) * 1000
    x = np.rint(np.repeat(centres, 60, axis=0) + rng.standard_normal((2400, 8)) * 20).astype(np.int64)
    top = float(np.einsum("ij,ij->i", x, x).max())
    rows = pa.table({"id": list(range(2400)), "x": x.tolist()})
    pages = metric_tree.build(top)((pa.scalar(0), pa.scalar(0)), rows)
    tree = metric_tree.Tree(pages, top)
    q = x[::100]
    best = tree.search(q, list(range(0, 2400, 100)), 3, np.full(len(q), np.inf))
    scores = q @ x.T
    for i, own in enumerate(best):
        expected = sorted(((int(s), j) for j, s in enumerate(scores[i]) if j != i * 100), key=order)[:3]
        assert own == expected
    assert tree.computed < 0.5 * len(q) * 2400
    for p in pages.to_pylist():  # covering radii hold
        v = np.frombuffer(p["vectors"], np.int64).reshape(p["n"], -1)
        assert np.allclose(metric_tree.apart(np.array([p["routing"]]), v, top)[0], p["distances"], atol=1e-3)
    assert max(len(p["ids"]) for p in pages.to_pylist()) <= metric_tree.LEAF


def test_inner_products_are_exact():
    big = np.array([[(1 << 29) + 1, -(1 << 28), 7]], np.int64)
    assert vectors.inner(big, big)[0, 0] == sum(int(c) ** 2 for c in big[0])
    assert vectors.inner(np.array([[1, 2, 3]]), np.array([[4]]))[0, 0] == 4


def whitening_of(rows):
    """ids, whole vectors, exact deviations, variances and components, worked out by numpy alone."""
    fit = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1 << 40 for c in v)]
    dims = max((len(v) for _, v in fit), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dims - len(v)) for _, v in fit]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array(x, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in fit], centred, deviations, values[::-1], axes[:, ::-1]


def check_whitening(found, rows):
    ids, centred, deviations, values, axes = whitening_of(rows)
    got = {}
    for r in found:
        got.setdefault(r.component, []).append(r)
    assert sorted(got) == list(range(1, min(8, int((np.sqrt(np.maximum(values, 0)) > 1e-8 * np.sqrt(values[0])).sum())) + 1))
    total = sum(deviations) / len(ids) ** 3
    for k, own in got.items():
        assert sorted((str(r.vec_id), r.deviation) for r in own) == sorted((str(i), d if d < 1 << 63 else None) for i, d in zip(ids, deviations, strict=True))
        assert {r.n for r in own} == {len(ids)} and max(r.identity_error for r in own) <= 1e-4
        assert abs(own[0].explained / (values[k - 1] / total) - 1) < 1e-9
        expected = centred @ axes[:, k - 1] / np.sqrt(values[k - 1])
        a, b = (sorted((str(i), round(s * w, 6)) for i, w in zip(ids, expected, strict=True)) for s in (1, -1))
        mine = sorted((str(r.vec_id), round(r.whitened, 6)) for r in own)
        assert any(all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-4 for x, y in zip(mine, e, strict=True)) for e in (a, b)), k


def whitening_rows(dims):
    rng = np.random.default_rng(dims)
    scale = 2.0 ** -np.arange(dims)  # well apart, so that components are unique
    rows = [(i, (rng.standard_normal(dims) * scale).tolist(), 0) for i in range(300)]
    odd = [(1000, None, 1), (1100, [None] * dims, 1), (1200, [NAN] * dims, 1), (1300, [-INF] * dims, 2), (1400, [0.25], 2), (None, [0.5] * dims, 3), (1700, [1e30] * dims, 1)]
    return rows + odd + [rows[7], rows[7]]


@pytest.mark.parametrize("dims", [1, 3, 12])
def test_whitening(spark, dims):
    rows = whitening_rows(dims)
    check_whitening(whitening.whitened(table_of(spark, rows)).collect(), rows)


def test_whitening_without_spread(spark):
    rows = [(i, [0.5, i % 2 / 4, 0.25], 0) for i in range(40)]  # one component
    check_whitening(whitening.whitened(table_of(spark, rows)).collect(), rows)
    for rows in ([(i, [0.5, 0.25], 0) for i in range(40)], [(1, [0.5, 0.25], 0)], [(1, [], 0)], [(1, None, 0)], []):
        out = whitening.whitened(table_of(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float((1 << 30) * (i % 3)), float(i % 5 << 20)], 0) for i in range(30)]
    check_whitening(whitening.whitened(table_of(spark, rows)).collect(), rows)


def test_whitening_query(spark):
    con = connect()
    rows = [(i, v.tolist(), c) for i, v, c in con.execute("select vec_id, embedding, label from embeddings").df().itertuples(index=False)]
    check_whitening(whitening.op13_whitening(spark, SF).collect(), rows)


@pytest.mark.parametrize("module", [hard_negatives, metric_tree])
def test_queries_against_sql(spark, module):
    (name, query), con = next(iter(module.QUERIES.items())), connect()
    same(query(spark, SF), module.ORACLES[name], con)
