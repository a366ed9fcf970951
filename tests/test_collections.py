"""All pairs of a collection: the same as single comparisons, no unwanted rows, and runs that go on where others ended."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from strandmill.operators import pairs, seeds
from strandmill.plans.compare import BY, CollectionComparison, Comparison
from strandmill.sources import genomes

FLIP = str.maketrans("ACGT", "TGCA")


def records(seed=6, copies=1):
    r = random.Random(seed)
    core = "".join(r.choice("ACGT") for _ in range(420))
    rows = [("a", core), ("a", "ACGT"), ("b", core[40:400][::-1].translate(FLIP)), ("b", core[:90]), ("c", core[:300] + "A" + core[300:]), ("d", "".join(r.choice("ACGT") for _ in range(200)))]
    rows += [(g, "A" * 60 + c) for g in "abc" for c in "CG" * copies]
    return [(g, i, f"r{i}", dna) for i, (g, dna) in enumerate(rows)]


def collection(spark, rows):
    return genomes.collection(spark.createDataFrame(rows, "name string, key bigint, ident string, dna string"), "name", ["key"])


def genome_of(x, name):
    return x.filter(F.col("genome") == name).drop("genome")


def wanted(spark, *names):
    return spark.createDataFrame([tuple(n) for n in names], "genome_x string, genome_y string")


PAIRS = ("ab", "ac", "bc", "ad", "ba")


@pytest.mark.parametrize(("fl", "cap"), [(1000, 10_000), (50, 10_000), (200, 20)])
def test_hits_are_those_of_single_comparisons(spark, fl, cap):
    x = collection(spark, records(copies=3))
    got = {}
    for h in seeds.collection_hits(x, wanted(spark, *PAIRS), 32, fl, cap=cap).collect():
        got.setdefault(h.genome_x + h.genome_y, []).append(tuple(h)[2:])
    for a, b in PAIRS:
        single = seeds.hits(genome_of(x, a), genome_of(x, b), 32, fl, cap=cap)
        assert sorted(got.get(a + b, [])) == sorted(map(tuple, single.collect())), (a, b)
    assert got["ab"]


def test_only_wanted_rows_are_joined(spark):
    """The last join makes the wanted hits and nothing else."""
    x = collection(spark, records())
    hits = seeds.collection_hits(x, wanted(spark, "ab", "ac"))
    n = hits.count()
    plan = hits._jdf.queryExecution().executedPlan()
    hits.write.format("noop").mode("overwrite").save()
    assert n and "CartesianProduct" not in plan.toString() and "BroadcastNestedLoopJoin" not in plan.toString()
    assert {(r.genome_x, r.genome_y) for r in hits.select(*BY).distinct().collect()} == {("a", "b"), ("a", "c")}


@pytest.mark.parametrize("percent", [False, True])
def test_results_are_those_of_single_comparisons(spark, percent):
    x = collection(spark, records())
    args = {"lmin": 20 if percent else 80, "percent": percent}
    c = CollectionComparison(x, wanted(spark, *PAIRS), **args)
    tables = {name: [tuple(r) for r in getattr(c, name).collect()] for name in ("fragments", "exported", "run_info", "coverage")}
    for a, b in (PAIRS[0], PAIRS[3]) if percent else (PAIRS[0], PAIRS[1], PAIRS[4]):
        single = Comparison(genome_of(x, a), genome_of(x, b), **args)
        for name, rows in tables.items():
            assert sorted(r[2:] for r in rows if r[:2] == (a, b)) == sorted(tuple(r) for r in getattr(single, name).collect()), (a, b, name)
    assert len(tables["fragments"]) > 4


@pytest.mark.parametrize("fl", [1, 1000])
def test_shared_words(spark, fl):
    r = random.Random(1)
    words = [(r.randrange(40), r.choice("abcde")) for _ in range(300)]
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    expected = {}
    for (c, g), n in counts.items():
        for (d, h), m in counts.items():
            if c == d and g < h and n <= fl and m <= fl:
                s, t = expected.get((g, h), (0, 0))
                expected[g, h] = s + 1, t + n * m
    got = pairs.shared_word_counts(spark.createDataFrame(words, "code bigint, genome string"), fl)
    assert {(x.genome_x, x.genome_y): (x.shared_words, x.n_hits) for x in got.collect()} == expected


def test_runs_go_on(spark, tmp_path):
    x = collection(spark, records())
    results, asked = pairs.PairResults(spark, f"file://{tmp_path}/results"), []

    def compare(missing):
        asked.append(sorted(r.genome_x + r.genome_y for r in missing.collect()))
        return CollectionComparison(x, missing, lmin=80).fragments

    def told(df):
        return sorted(map(tuple, df.select(sorted(df.columns)).collect()))

    first = told(results.complete(wanted(spark, "ab"), x, compare, "p"))
    every = told(results.complete(wanted(spark, "ab", "ac", "ab"), x, compare, "p"))
    assert asked == [["ab"], ["ac"]] and first and set(first) < set(every)
    assert every == told(CollectionComparison(x, wanted(spark, "ab", "ac"), lmin=80).fragments)
    assert told(results.complete(wanted(spark, "ab", "ac"), x, compare, "p")) == every and len(asked) == 2
    # A run that is killed before its pairs are written has done nothing.
    (latest,) = [d for d in (tmp_path / "results").iterdir() if any((d / "pairs").glob("*.parquet")) and "ac" in {r.genome_x + r.genome_y for r in spark.read.parquet(str(d / "pairs")).collect()}]
    shutil.rmtree(latest / "pairs")
    assert told(results.complete(wanted(spark, "ab", "ac"), x, compare, "p")) == every and asked[2:] == [["ac"]]
    results.complete(wanted(spark, "ab"), x, compare, "other")
    changed = collection(spark, [(g, k, i, dna + "A" if g == "c" else dna) for g, k, i, dna in records()])
    results.complete(wanted(spark, "ab", "ac"), changed, compare, "p")
    assert asked[3:] == [["ab"], ["ac"]]
