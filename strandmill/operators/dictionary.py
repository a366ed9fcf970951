"""Word dictionaries: how often and where each word occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.dna import packed_word

#: Words with this many places or more are outliers; above this many places are strided.
OUTLIER, STRIDED = 1001, 10_000
#: Bases of a range in which a strided word's places are numbered on their own.
RANGE = 1 << 20


def dictionary(words: DataFrame) -> DataFrame:
    """code, num."""
    return words.groupBy("code").agg(F.count(F.lit(1)).alias("num"))


def locations(words: DataFrame, most: int = 12) -> DataFrame:
    """code, num and the first `most` places (seq, pos). Only those are gathered, so a very frequent word
    is no large group."""
    ranked = words.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("seq", "pos"))).filter(F.col("n") <= most)
    first = ranked.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("seq", "pos"))).alias("locs"))
    return merged(dictionary(words), first, ["code"])


def histogram(counts: DataFrame) -> DataFrame:
    """n_words for each num below the outliers. counts: code, num, of a dictionary."""
    return counts.filter(F.col("num") < OUTLIER).groupBy("num").agg(F.count(F.lit(1)).alias("n_words"))


def summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("n_words"), F.max("num").alias("max_num"), F.sum("num").alias("sum_num"), F.round(F.avg("num"), 6).alias("avg_num"))


def outliers(counts: DataFrame, least: int = OUTLIER) -> DataFrame:
    return counts.filter(F.col("num") >= least).select(packed_word(F.col("code")).alias("word"), "num")


def frequent_enough(words: DataFrame, fl: int, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Words whose number of places is at most fl, with num. Numbers are pre-aggregated; of the words
    themselves at most fl rows share a key after the filter."""
    counts = words.groupBy(*by).agg(F.count(F.lit(1)).alias("num")).filter(F.col("num") <= fl)
    return merged(words, counts, list(by))


def merged(words: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Both sides sorted: Spark guesses the size of words from that of the texts, which are far smaller,
    and would broadcast what has no bound."""
    return words.join(counts.hint("merge"), by)


def strided(words: DataFrame, cap: int = STRIDED, by: tuple[str, ...] = ("code",), span: int = RANGE) -> DataFrame:
    """Keeps every (num div cap)-th place of a word, by (seq, pos), if it has over cap of them. words has num,
    and is read three times: pass a written table.

    The places of a word that has any to be left out are numbered in ranges of `span` bases, and the ranges'
    totals are added up, so that a word that is everywhere is not one group.
    """
    step = F.floor(F.col("num") / cap)
    many = words.filter(step > 1).withColumn("__range", F.floor(F.col("pos") / span))
    totals = many.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(*by, "__range", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("seq", "pos")) - 1
    numbered = many.withColumn("__n", place).join(totals.hint("merge"), [*by, "__range"])
    kept = numbered.filter(F.pmod(F.col("__n") + F.col("__before"), step) == 0)
    return words.filter(step <= 1).unionByName(kept.select(*words.columns))
