"""FASTA that is compressed, and its blocks, take less room than the bases."""

import os
import random

from test_operators import genome

from strandmill.sources import blocks, fasta


def held(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_compressed_fasta_and_its_blocks(spark, tmp_path):
    r = random.Random(2)
    x = genome(spark, *["".join(r.choice("ACGT") for _ in range(n)) for n in (90_000, 0, 31, 250, 70_000)])
    fasta.write_fasta(x, f"file://{tmp_path}/fasta", 80, "gzip")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    own = blocks.read_blocks(spark, f"file://{tmp_path}/fasta")
    written = {p for p in set(os.listdir(shared)) - before if held(os.path.join(shared, p)) > 20_000}
    assert {p.split("-")[0] for p in written} == {"pieces", "block"}  # bases are written as pieces and as blocks, and no third time
    assert held(tmp_path) < 80_000 and sum(held(os.path.join(shared, p)) for p in written) < 120_000
    found = {}
    for b in sorted(own.blocks.collect(), key=lambda b: (b.seq, b.block)):
        found[b.seq] = found.get(b.seq, "") + b.bases
        assert b.tail == x.filter(f"seq = {b.seq}").first().dna[(b.block + 1) * own.size :][:31]
    assert [(s.seq, s.ident, s.dna) for s in x.orderBy("seq").collect()] == [(s.seq, s.ident, found.get(s.seq, "")) for s in own.records.orderBy("seq").collect()]
