"""Whole comparisons of two genomes, and of all pairs of a collection."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strandmill.operators.dictionary import STRIDED
from strandmill.operators.extension import extend
from strandmill.operators.fragments import LAST_LENGTH, coverage, export, fragments, judged, least_length, least_lengths
from strandmill.operators.records import accepted
from strandmill.operators.seeds import collection_hits, hits
from strandmill.operators.stored import StoredDictionary, stored_hits
from strandmill.operators.thinning import single_hits, skip_covered, thin, thin_runs
from strandmill.operators.tiles import PAIRS, found
from strandmill.sources.blocks import BlockedGenome, blocked, strand_of
from strandmill.sources.genomes import totals
from strandmill.storage import saved, small


#: Letters of words up to which fragments are made record by record, as hits are too many to be written.
SHORT = 16


def with_separators(total: Row) -> int:
    """The length of a genome as run information tells it: a separator stands between two records."""
    return total["total_length"] + max(total["n_sequences"] - 1, 0)


@dataclass
class Comparison:
    """Both strands of y against x. Each table is made when it is first asked for; hits, thinned hits, their
    fragments and the used seeds are written to the shared folder.

    x and y are tables of sequences, or genomes in blocks, which any record fits. stored: the dictionaries of x and of y's
    strands, if a store has them; they bring k with them."""

    x: DataFrame | BlockedGenome
    y: DataFrame | BlockedGenome
    k: int = 32
    lmin: int = 100
    simthr: float = 65
    fl: int = 1000
    strands: str = "fr"
    percent: bool = False
    stored: tuple[StoredDictionary, list[StoredDictionary]] | None = None

    def __post_init__(self):
        self._kept: dict[str, DataFrame] = {}
        self._blocks: dict[str, BlockedGenome] = {}
        #: Seconds that each written table took.
        self.timings: dict[str, float] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            df = make()  # what it stands on has times of its own
            began = time.perf_counter()
            self._kept[name] = saved(df, name)
            self.timings[name] = time.perf_counter() - began
        return self._kept[name]

    def records(self, side: str) -> DataFrame:
        own = getattr(self, side)
        return own.records if isinstance(own, BlockedGenome) else own

    def blocks(self, side: str) -> BlockedGenome:
        """The blocks of the records that have a thinned hit; of a genome in blocks, all."""
        own = getattr(self, side)
        if side not in self._blocks:
            self._blocks[side] = own if isinstance(own, BlockedGenome) else blocked(own, wanted=self._met(side))
        return self._blocks[side]

    def _met(self, side: str) -> DataFrame:
        if side == "x":
            return self.thinned.select(F.col("seqX").alias("seq"))
        last = self.size("y")["n_sequences"] - 1
        return self.thinned.select(F.when(F.col("strand") == "r", last - F.col("seqY")).otherwise(F.col("seqY")).alias("seq"))

    def size(self, side: str) -> Row:
        """n_sequences and total_length."""
        return totals(self.records(side)).first()

    @property
    def hits(self) -> DataFrame:
        if self.stored:
            return self._once("hits", lambda: stored_hits(self.stored[0], [y for y in self.stored[1] if y.strand in self.strands], self.fl))
        return self._once("hits", lambda: hits(self.x, self.y, self.k, self.fl, self.strands))

    @property
    def thinned(self) -> DataFrame:
        return self._once("thinned", lambda: thin(self.hits, self.k))

    @property
    def extended(self) -> DataFrame:
        """Every thinned hit's fragment, with accepted."""
        if "extended" not in self._kept:  # the states it is read off are written
            self._kept["extended"] = judged(extend(self.thinned, self.blocks("x"), self.blocks("y"), self.k), self.least, self.simthr)
        return self._kept["extended"]

    @property
    def least(self) -> int:
        return least_length(self.lmin, *[self.records(s) for s in "xy"]) if self.percent else self.lmin

    @property
    def used(self) -> DataFrame:
        return self._once("used", lambda: skip_covered(self.extended))

    @property
    def fragments(self) -> DataFrame:
        return fragments(self._barring(), self.size("y")["n_sequences"])

    def _barring(self) -> DataFrame:
        """The used seeds, or the accepted ones among them: others bar none."""
        whole = isinstance(self.x, BlockedGenome) or isinstance(self.y, BlockedGenome) or self.stored
        if self.k > SHORT or self.fl >= 2 * STRIDED or whole or "used" in self._kept:
            return self.used
        if "accepted" not in self._kept:
            strands = {s: strand_of(self.y, s) for s in self.strands}
            found = accepted(self.x, strands, self.k, self.fl, self.least, self.simthr)
            if found is None:
                return self.used
            self._once("accepted", lambda: found.withColumn("accepted", F.lit(True)))
        return self._once("barring", lambda: skip_covered(self._kept["accepted"]))

    @property
    def coverage(self) -> DataFrame:
        return coverage(self.used)

    @property
    def exported(self) -> DataFrame:
        return export(self.fragments, self.size("y")["total_length"])

    @property
    def run_info(self) -> DataFrame:
        """One row for each strand, and one for both."""
        n_hits = self.thinned.groupBy("strand").agg(F.count(F.lit(1)).alias("hits"))
        used = self.used.groupBy("strand").agg(F.count(F.lit(1)).alias("hits_used"), F.sum(F.col("accepted").cast("bigint")).alias("fragments"))
        both = n_hits.join(used, "strand", "left").na.fill(0)
        both = both.unionByName(both.agg(F.lit("both").alias("strand"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "hits_used", "fragments")]))
        lengths = [with_separators(self.size(g)) for g in "xy"]
        return both.select("strand", *[F.lit(v).cast("bigint").alias(c) for c, v in zip(("len_x", "len_y", "lmin", "simthr"), (*lengths, self.lmin, int(self.simthr)), strict=True)], "hits", "hits_used", "fragments")


BY = ("genome_x", "genome_y")


@dataclass
class CollectionComparison:
    """All of some pairs of a collection's genomes, both strands, as one job: pairs (genome_x, genome_y) are
    columns of every table, so that no pair is a job or a task of its own. Each pair has the results that a comparison of its
    two genomes has. percent: lmin is percent of the shorter first record of each pair."""

    sequences: DataFrame
    pairs: DataFrame
    k: int = 32
    lmin: int = 100
    simthr: float = 65
    fl: int = 1000
    percent: bool = False

    def __post_init__(self):
        self.pairs = saved(self.pairs.select(*BY).distinct(), "pairs")
        self.sizes = saved(self.sequences.groupBy("genome").agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_length")), "sizes")
        self._least = saved(least_lengths(self.lmin, self.pairs, self.sequences), "least") if self.percent else None
        #: What pairs of tiles tell, if records are short enough for them; then no table of all hits or seeds is made unless it is asked for.
        self._found = None
        if self.fl < 2 * STRIDED:
            least = {(r["genome_x"], r["genome_y"]): r["least"] for r in self._least.limit(PAIRS).collect()} if self.percent else self.lmin
            self._found = found(self.sequences, self.pairs, least, self.simthr, self.k, self.fl)
        self._seeds = self.used.withColumns({"sure": F.lit(False), "n": F.lit(1).cast("bigint")}) if self._found is None else saved(skip_covered(self._found.filter("NOT sure"), BY), "seeds")

    @cached_property
    def runs(self) -> DataFrame:
        return saved(collection_hits(self.sequences, self.pairs, self.k, self.fl, runs=True), "hits")

    @cached_property
    def thinned(self) -> DataFrame:
        return saved(thin_runs(self.runs, self.k, BY), "thinned")

    @cached_property
    def extended(self) -> DataFrame:
        own = blocked(self.sequences)
        rows, least = extend(self.thinned, own, own, self.k), F.lit(self.lmin)
        if self.percent:
            rows, least = rows.join(small(self._least), [*BY]), F.col("least")
        return judged(rows, least, self.simthr).drop("least")

    @cached_property
    def used(self) -> DataFrame:
        return saved(skip_covered(self.extended, BY), "used")

    def _counted(self) -> DataFrame:
        """The used seeds, or as many rows as tell length, similarity and number (n) of all of them."""
        return self._seeds if self._found is None else self._seeds.unionByName(self._found.filter("sure"))

    @property
    def hits(self) -> DataFrame:
        return single_hits(self.runs)

    @property
    def parameters(self) -> str:
        """What results depend on besides the sequences."""
        return f"k={self.k} lmin={self.lmin}{'%' * self.percent} simthr={self.simthr} fl={self.fl}"

    def _of_y(self) -> DataFrame:
        return small(self.sizes.select(F.col("genome").alias("genome_y"), F.col("n_sequences").alias("n_y"), F.col("total_length").alias("y_total")))

    @property
    def fragments(self) -> DataFrame:
        """The fragments of each pair, seqY counted from the forward strand's first record."""
        return fragments(self._seeds.join(self._of_y(), "genome_y"), F.col("n_y"), BY)

    @property
    def coverage(self) -> DataFrame:
        each = self._counted().groupBy(*BY, F.least("length", F.lit(LAST_LENGTH)).cast("int").alias("len_bin"), F.floor("similarity").cast("int").alias("sim_bin"))
        return each.agg(F.sum("n").alias("n"))

    @property
    def exported(self) -> DataFrame:
        """The CSV of each pair, with the pair's names."""
        return export(self.fragments.join(self._of_y(), "genome_y"), F.col("y_total"), BY)

    @property
    def run_info(self) -> DataFrame:
        """For each pair a row for each strand with hits, and one for both."""
        zero, counts = F.lit(0).cast("bigint"), ("hits", "hits_used", "fragments")
        thinned = self.thinned.select(*BY, "strand", F.lit(1).cast("bigint").alias("n")) if self._found is None else self._found
        n = thinned.select(*BY, "strand", F.col("n").alias("hits"), zero.alias("hits_used"), zero.alias("fragments"))
        n = n.unionByName(self._counted().select(*BY, "strand", zero.alias("hits"), F.col("n").alias("hits_used"), F.col("accepted").cast("bigint").alias("fragments")))
        each = n.groupBy(*BY, "strand").agg(*[F.sum(c).alias(c) for c in counts])
        both = self.pairs.join(each.groupBy(*BY).agg(*[F.sum(c).alias(c) for c in counts]), [*BY], "left")
        both = both.select(*BY, F.lit("both").alias("strand"), *[F.coalesce(c, zero).alias(c) for c in counts])
        length = F.col("total_length") + F.greatest(F.col("n_sequences") - 1, zero)
        x, y = (small(self.sizes.select(F.col("genome").alias(f"genome_{s}"), length.alias(f"len_{s}"))) for s in "xy")
        told = {"lmin": F.lit(self.lmin).cast("bigint"), "simthr": F.lit(int(self.simthr)).cast("bigint")}
        return each.unionByName(both).join(x, "genome_x").join(y, "genome_y").select(*BY, "strand", "len_x", "len_y", *[v.alias(c) for c, v in told.items()], *counts)
