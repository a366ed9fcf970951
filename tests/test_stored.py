"""Stored dictionaries: the same hits as from sequences, without an exchange and without making words anew."""

import random
import re
import shutil

import pyarrow.parquet as pq
import pytest

from strandmill.operators import cells, dictionary, seeds, stored
from strandmill.sources import genomes


def genome(spark, *records):
    rows = [(i, f"r{i}", d) for i, d in enumerate(records)]
    return genomes.genome(spark.createDataFrame(rows, "key bigint, ident string, dna string"), "key")


def texts(seed=4):
    r = random.Random(seed)
    core = "".join(r.choice("ACGT") for _ in range(300))
    return [core, core[50:200], "A" * 200, "N" * 10, "".join(r.choice("ACGT") for _ in range(90))], [core[20:260], "A" * 120, core[::-1].translate(str.maketrans("ACGT", "TGCA"))]


def told(df):
    return sorted(map(tuple, df.select("strand", "diag", "posX", "posY", "seqX", "seqY").collect()))


def store_of(spark, tmp_path, k=32, buckets=3):
    return stored.DictionaryStore(spark, f"file://{tmp_path}/store", k, buckets)


@pytest.mark.parametrize("k", [32, 16])
@pytest.mark.parametrize(("fl", "hot", "cap"), [(1000, 10_000, 10_000), (5, 3, 10_000), (1000, 20, 10_000), (1000, 20, 25)])
def test_same_hits(spark, tmp_path, monkeypatch, k, fl, hot, cap):
    monkeypatch.setattr(stored, "HOT", hot)
    a, b = texts()
    x, y, store = genome(spark, *a), genome(spark, *b), store_of(spark, tmp_path, k)
    dx, ys = store.put("x", x), [store.put("y", y, s) for s in "fr"]
    assert (dx.n_hot > 0) == (hot < 1000)
    got = told(stored.stored_hits(dx, ys, fl, cap))
    assert got == told(seeds.hits(x, y, k, fl, cap=cap)) and got


def test_plan_has_no_exchange(spark, tmp_path):
    a, b = texts()
    store = store_of(spark, tmp_path)
    dx, ys = store.put("x", genome(spark, *a)), [store.put("y", genome(spark, *b), s) for s in "fr"]
    plan = stored.stored_hits(dx, ys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and len(re.findall("Bucketed: true", plan)) == 4


def test_later_comparisons_make_no_words(spark, tmp_path, monkeypatch):
    a, b = texts()
    x, y = genome(spark, *a), genome(spark, *b)
    store_of(spark, tmp_path).put("x", x)
    made = []
    monkeypatch.setattr(stored, "kmers", lambda s, *args, **kw: made.append(s) or seeds.kmers(s, *args, **kw))
    store = store_of(spark, tmp_path)
    dx = store.put("x", x)
    assert not made
    got = told(stored.stored_hits(dx, [store.put("y", y)]))
    assert len(made) == 2 and got == told(seeds.hits(x, y, strands="f"))
    assert told(stored.stored_hits(store.get("x"), [store.put("x", x)])) == told(seeds.hits(x, x, strands="f"))


def test_a_new_session_reads_the_store(spark, tmp_path):
    a, b = texts()
    x, y, store = genome(spark, *a), genome(spark, *b), store_of(spark, tmp_path)
    before = told(stored.stored_hits(store.put("x", x), [store.put("y", y, "r")]))
    for name, strand in (("x", "f"), ("y", "r")):
        spark.sql(f"DROP TABLE {store._table(name, strand)}")  # as in another session; the files stay
    again = store_of(spark, tmp_path)
    df = stored.stored_hits(again.get("x"), [again.get("y", "r")])
    assert told(df) == before and before and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_job_that_failed_is_done_again(spark, tmp_path):
    a, _ = texts()
    x, store = genome(spark, *a), store_of(spark, tmp_path)
    n = store.put("x", x).common.count()
    shutil.rmtree(store.path("x", "f", "info").removeprefix("file://"))  # what is written last
    assert not store.has("x")
    with pytest.raises(KeyError):
        store.get("x")
    assert store.put("x", x).common.count() == n


def test_stores_of_another_kind_are_refused(spark, tmp_path):
    store_of(spark, tmp_path).put("x", genome(spark, texts()[0][0]))
    with pytest.raises(ValueError, match="k 32 and 3 buckets"):
        store_of(spark, tmp_path, 16).put("x", genome(spark, texts()[0][0]))


def test_empty_genome(spark, tmp_path):
    store = store_of(spark, tmp_path)
    d = store.put("none", genome(spark))
    assert (d.n_sequences, d.total_length, d.n_hot) == (0, 0, 0)
    assert stored.stored_hits(store.put("x", genome(spark, texts()[0][0])), [d]).count() == 0
    assert dictionary.dictionary(d.common).count() == 0


@pytest.mark.parametrize("k", [32, 16])
@pytest.mark.parametrize(("fl", "hot", "cap", "large"), [(1000, 10_000, 10_000, 60), (5, 3, 10_000, 60), (1000, 20, 10_000, 25), (1000, 20, 25, 60)])
def test_same_hits_of_large_cells(spark, tmp_path, monkeypatch, k, fl, hot, cap, large):
    monkeypatch.setattr(stored, "HOT", hot)
    monkeypatch.setattr(cells, "LARGE", large)
    monkeypatch.setattr(cells, "DEALT", 30)
    a, b = texts()
    x, y, store = genome(spark, *a), genome(spark, *b), stored.DictionaryStore(spark, f"file://{tmp_path}/store", k, 3, cells=8)
    dx, ys = store.put("x", x), [store.put("y", y, s) for s in "fr"]
    assert dx.n_large > 0 and (dx.n_hot > 0) == (hot < 1000)
    got = told(stored.stored_hits(dx, ys, fl, cap))
    assert got == told(seeds.hits(x, y, k, fl, cap=cap)) and got
    assert dx.common.filter("num > 1").count() == seeds.frequent_enough(seeds.kmers(x), hot).filter("num > 1").count()


def test_cells_take_few_bytes_a_word(spark, tmp_path):
    r = random.Random(5)
    store = stored.DictionaryStore(spark, f"file://{tmp_path}/store", 32, 3, cells=64)
    store.put("x", genome(spark, *("".join(r.choice("ACGT") for _ in range(50_000)) for _ in range(4))))
    written = sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet"))
    assert store.get("x").common.count() == 4 * (50_000 - 31) and written < 3 * 4 * 50_000
    assert store.get("x").cells.count() <= 64


def test_groups_of_rows_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "GROUP", 1 << 13)
    r = random.Random(6)
    store = stored.DictionaryStore(spark, f"file://{tmp_path}/store", 32, 1, cells=128)
    store.put("x", genome(spark, *("".join(r.choice("ACGT") for _ in range(20_000)) for _ in range(4))))
    (file,) = (tmp_path / "store").rglob("common/*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups > 2
