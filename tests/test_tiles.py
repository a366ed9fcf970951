"""All pairs by pairs of tiles: the same as by tables of hits and seeds, of which none is written."""

import random

import numpy as np
import pytest

from strandmill.operators import tiles
from strandmill.operators.kmers import base_codes
from strandmill.plans import compare
from strandmill.plans.compare import CollectionComparison
from strandmill.sources import genomes

FLIP = str.maketrans("ACGT", "TGCA")
TABLES = ("fragments", "exported", "run_info", "coverage")


def collection(spark, seed=3):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choice("ACGT") for _ in range(n))

    core, often = text(700), "ACGGT" * 9
    changed = "".join(r.choice("ACGT") if r.random() < 0.04 else c for c in core)
    rows = {
        "a": [core, "", often + text(60), core[:200], "ACGTN" * 20 + core[300:420], text(90), often],
        "b": [text(50), changed, often, "", core[100:500][::-1].translate(FLIP), core[:200] + core[:200], often],
        "c": [core[350:], core[:350], often + often, text(30), changed[::-1].translate(FLIP)],
    }
    own = [(g, i, f"{g}{i}", dna) for g, records in rows.items() for i, dna in enumerate(records)]
    return genomes.collection(spark.createDataFrame(own, "name string, key bigint, ident string, dna string"), "name", ["key"])


@pytest.mark.parametrize(("size", "fl", "percent"), [(1 << 20, 1000, False), (300, 1000, True), (300, 3, False)])
def test_tiles_give_what_tables_of_hits_give(spark, monkeypatch, size, fl, percent):
    x = collection(spark)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b"), ("a", "gone")], "genome_x string, genome_y string")
    args = {"lmin": 8 if percent else 60, "fl": fl, "percent": percent}
    monkeypatch.setattr(tiles, "TILE", size)
    monkeypatch.setattr(tiles, "LEAST", size)
    c = CollectionComparison(x, pairs, **args)
    assert c._found.filter("sure").count() > 0 or size < 1000  # where tiles are short, any seed may lie in a fragment of the tile before
    got = {t: sorted(map(tuple, getattr(c, t).collect())) for t in TABLES}
    assert not {"runs", "thinned", "extended", "used"} & set(vars(c))  # none of these was made
    monkeypatch.setattr(compare, "found", lambda *_: None)
    whole = CollectionComparison(x, pairs, **args)
    for t in TABLES:
        assert got[t] == sorted(map(tuple, getattr(whole, t).collect())) and got[t], t


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
@pytest.mark.parametrize("k", [9, 32])
def test_hits_some_at_a_time(monkeypatch, most, k):
    """Also where one record of X has too many hits with Y for one go."""
    r = random.Random(5)
    core = "".join(r.choice("ACGT") for _ in range(80))
    texts = [[core, "", core[10:60] * 2, "ACG" * 30], [core[:50], core * 2, "CGA" * 20, ""]]
    made = []
    for own in texts:
        length = np.array([len(t) for t in own])
        begin = np.append(0, np.cumsum(length[:-1] + 1))
        made.append(tiles.Strand(np.frombuffer("\n".join(own).encode(), np.uint8), 0, begin, length, np.arange(len(own)), None))
    monkeypatch.setattr(tiles, "HITS", most)
    x, y = made
    codes = tuple(base_codes(s.bases, "skip") for s in made)
    got = [(int(p), int(q)) for h in tiles._hits(x, y, x.words(k, "skip"), y.words(k, "skip"), codes, k) for p, q in zip(*h[:2], strict=True)]
    words = [{i: s.bases[i : i + 32].tobytes() for i in range(len(s.bases) - 31) if b"\n" not in s.bases[i : i + 32].tobytes()} for s in made]
    assert sorted(got) == sorted((i, j) for i, a in words[0].items() for j, b in words[1].items() if a[:k] == b[:k]) and got
