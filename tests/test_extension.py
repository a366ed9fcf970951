"""The extension over blocks against hand-derived values and a slow model, and genomes in blocks."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import S32, S40, genome, slow_extension

from strandmill.operators import extension, kmers, thinning
from strandmill.plans.compare import CollectionComparison, Comparison
from strandmill.sources import blocks, fasta, genomes

FLIP = str.maketrans("ACGT", "TGCA")


def extended(spark, pairs, k, size, strand="f"):
    """(left, ahead, identities, score) of a seed for each (x, y, p, q); y is turned for the reverse strand, so that its own order is the one given."""
    xs, ys = [x for x, *_ in pairs], [y for _, y, *_ in pairs]
    stored = ys if strand == "f" else [y[::-1].translate(FLIP) for y in reversed(ys)]
    x, y = (blocks.blocked(genome(spark, *g), size) for g in (xs, stored))
    rows, x_at, y_at = [], 0, 0
    for i, (a, b, p, q) in enumerate(pairs):
        rows.append((strand, x_at + p - y_at - q, x_at + p, y_at + q, i, i))
        x_at, y_at = x_at + len(a) + 1, y_at + len(b) + 1
    out = extension.extend(spark.createDataFrame(rows, thinning.HIT), x, y, k).collect()
    assert all(r.xEnd - r.xStart == r.yEnd - r.yStart == r.length - 1 for r in out)
    return [(r.posX - r.seqX - r.xStart, r.xEnd - (r.posX - r.seqX), r.ident, r.score) for r in sorted(out, key=lambda r: r.seqX)]


CASES = [
    (S40, S40, 0, (0, 39, 40, 160)),
    (S32, S32, 0, (0, 32, 32, 128)),
    (S32 + "NACGTA", S32 + "NACGTA", 0, (0, 37, 37, 147)),
    (S32 + "AACGTA", S32 + "CACGTA", 0, (0, 37, 37, 144)),
    ("ACGTAG" + S32, "ACGTAT" + S32, 6, (6, 32, 37, 144)),
]


@pytest.mark.parametrize("size", [31, 1 << 16])
def test_extension(spark, size):
    assert extended(spark, [(x, y, p, p) for x, y, p, _ in CASES], 32, size) == [e for *_, e in CASES]


def random_pairs(seed, n, side):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        core = "".join(r.choice("ACGT") for _ in range(6))
        sides = ["".join(r.choice("AACGTN") for _ in range(r.randrange(side))) for _ in range(4)]
        shared = [sides[i] if r.random() < 0.5 else sides[i - 1] for i in (1, 3)]
        shared = ["".join(c if r.random() < 0.9 else "T" for c in s) for s in shared]
        x, y = sides[0] + core + sides[2], shared[0] + core + shared[1]
        out.append((x, y, len(sides[0]), len(shared[0])))
    return out


@pytest.mark.parametrize("strand", ["f", "r"])
@pytest.mark.parametrize(("size", "side", "step"), [(31, 40, 3), (40, 400, 7), (1 << 16, 60, 256)])
def test_against_slow_model(spark, monkeypatch, strand, size, side, step):
    monkeypatch.setattr(extension, "STEP", step)
    monkeypatch.setattr(extension, "PAIR_HITS", 3)
    pairs = random_pairs(size + side, 200, side)
    assert extended(spark, pairs, 6, size, strand) == [slow_extension(x, y, p, q, 6) for x, y, p, q in pairs]


@pytest.mark.parametrize("seed", range(20))
def test_stretches_pass_as_the_walk_does(seed):
    import numpy as np

    r = random.Random(seed)
    a = np.frombuffer("".join(r.choice("ACGTN") for _ in range(60)).encode(), np.uint8)
    b = np.where(np.array([r.random() < 0.7 for _ in a]), a, 65).astype(np.uint8)
    for now in (0, 10, 100):
        state = (now, now + r.randrange(30), 3, 2, 7, 4)
        fell, after = extension.walk(a, b, state)
        assert extension.passed(state, extension.stretch(a, b)) == (None if fell else after)


def test_records_of_many_blocks(spark):
    """Two copies of a record of 150 blocks, one with mismatches; on both strands. No row of any table holds more than a block."""
    r = random.Random(8)
    size = 64
    x = "".join(r.choice("ACGT") for _ in range(150 * size + 17))
    y = "".join(c if r.random() < 0.99 else "A" for c in x[100:-60])
    for turn in (False, True):
        gx, gy = genome(spark, "ACGT", x), genome(spark, y[::-1].translate(FLIP) if turn else y, "GG")
        bx, by = blocks.blocked(gx, size), blocks.blocked(gy, size)
        assert max(b.blocks.agg(F.max(F.length("bases"))).first()[0] for b in (bx, by)) == size and bx.blocks.count() == 152
        c = Comparison(bx, by)
        found = [tuple(f) for f in c.fragments.collect()]
        assert max(f[5] for f in found) > 140 * size  # one fragment nearly as long as the record
        strand, diag = "r" if turn else "f", max(found, key=lambda f: f[5])[0]
        seeds = [e for e in c.extended.collect() if e.strand == strand and e.diag == diag]
        for e in seeds[:: len(seeds) // 5]:
            own = slow_extension(x, y, e.posX - 5, e.posY - (3 if turn else 0), 32)
            assert (e.posX - 1 - e.xStart, e.xEnd - (e.posX - 1), e.ident, e.score) == own


def test_blocks_give_the_words_of_the_genome(spark):
    g = genome(spark, S40 * 5, "", "ACGT", S32, S40[::-1] * 3)
    own = blocks.blocked(g, 33)

    def told(words):
        return sorted(map(tuple, words.select("code", "seq", "pos").collect()))

    assert told(kmers.kmers(own.pieces("f"))) == told(kmers.kmers(g))
    assert told(kmers.kmers(own.pieces("r"))) == told(kmers.kmers(genomes.reversed_genome(g)))


def bases_of(own):
    rows = own.blocks.groupBy("seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "bases"))), lambda b: b["bases"]), "").alias("dna"))
    joined = own.records.join(rows, "seq", "left").select("seq", "ident", F.coalesce("dna", F.lit("")).alias("dna"), "len", "g_off")
    return sorted(map(tuple, joined.collect()))


def read_both(spark, path, size=40):
    """read_blocks over splits of 64 bytes, and read_fasta, which doesn't cut records."""
    whole = sorted(map(tuple, fasta.read_fasta(spark, path).select("seq", "ident", "dna", "len", "g_off").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "8b")
    try:
        own = blocks.read_blocks(spark, path, size)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    return own, whole


def test_fasta_in_splits(spark, tmp_path):
    r = random.Random(2)
    for k in range(6):
        lines = ["passed over", "AC"] if k % 2 else []
        for i in range(r.randrange(5)):
            dna = "".join(r.choice("ACGTNacgt") for _ in range(r.choice([0, 1, 30, 400, 700])))
            lines += [f"> r{k}-{i} of > many", *[dna[a : a + 23] for a in range(0, len(dna), 23)], ""]
        (tmp_path / f"f{k}.fasta").write_text("\r\n".join(lines) if k % 3 else "\n".join(lines))
    own, whole = read_both(spark, f"file://{tmp_path}")
    assert bases_of(own) == whole and len(whole) > 5
    assert max(map(len, (b.bases for b in own.blocks.collect()))) <= 40


def test_one_record_is_read_by_several_tasks(spark, tmp_path):
    r = random.Random(3)
    dna = "".join(r.choice("ACGT") for _ in range(4000))
    (tmp_path / "a.fasta").write_text(">one\n" + "\n".join(dna[a : a + 60] for a in range(0, 4000, 60)) + "\n")
    own, whole = read_both(spark, f"file://{tmp_path}/a.fasta")
    assert bases_of(own) == whole == [(0, "one", dna, 4000, 0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        lines = spark.read.option("lineSep", "\n").text(f"file://{tmp_path}/a.fasta")
        assert lines.select(F.spark_partition_id()).distinct().count() >= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = [b.tail for b in sorted(own.blocks.collect(), key=lambda b: b.block)]
    assert found == [dna[a + 40 : a + 71] for a in range(0, 4000, 40)]
    (tmp_path / "empty.fasta").write_text("")
    own, whole = read_both(spark, f"file://{tmp_path}/empty.fasta")
    assert bases_of(own) == whole == []


def test_collections_in_blocks(spark):
    """The fragments of a collection don't depend on the size of blocks."""
    r = random.Random(6)
    core = "".join(r.choice("ACGT") for _ in range(500))
    rows = [("a", 0, "x", core), ("a", 1, "y", "ACGT"), ("b", 0, "z", core[40:460][::-1].translate(FLIP)), ("c", 0, "w", core[:300] + "A" + core[300:])]
    x = genomes.collection(spark.createDataFrame(rows, "name string, key bigint, ident string, dna string"), "name", ["key"])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "genome_x string, genome_y string")
    whole = sorted(map(tuple, CollectionComparison(x, pairs).fragments.collect()))
    size = blocks.BLOCK
    try:
        blocks.blocked.__defaults__ = (50,)
        assert sorted(map(tuple, CollectionComparison(x, pairs).fragments.collect())) == whole and whole
    finally:
        blocks.blocked.__defaults__ = (size,)


def test_only_records_with_a_hit_are_made_into_blocks(spark):
    met, alone = S40 + "ACGTTGCA" * 9, "GATTACAA" * 10
    c = Comparison(genome(spark, alone, met, alone), genome(spark, alone[::-1], met[::-1].translate(FLIP)), lmin=30)
    assert c.fragments.count() > 0
    assert {r.seq for r in c.blocks("x").blocks.collect()} == {1} and {r.seq for r in c.blocks("y").blocks.collect()} == {1}
    assert c.blocks("x").records.count() == 3
