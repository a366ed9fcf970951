"""Text reports of a comparison: run information, coverage matrix, word frequencies, fragments as CSV.

Matrices and run information are of a fixed size, and each is one file. Frequencies and fragments grow
with the input: they are sorted by range and written in parts, whose order by name is that of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.dna import packed_word
from strandmill.operators.dictionary import OUTLIER, dictionary
from strandmill.operators.fragments import LAST_LENGTH
from strandmill.storage import saved

#: Fixed values of the format: first line, labels by column, closing rule, heads of the tables.
TITLE = "All by-Identity Ungapped Fragments (Hits based approach)"
LABELS = {
    "file_x": "SeqX filename",
    "file_y": "SeqY filename",
    "name_x": "SeqX name",
    "name_y": "SeqY name",
    "len_x": "SeqX length",
    "len_y": "SeqY length",
    "lmin": "Min.fragment.length",
    "simthr": "Min.Identity",
    "hits": "Tot Hits (seeds)",
    "hits_used": "Tot Hits (seeds) used",
    "fragments": "Total fragments",
}
RULE = "=" * 56
FREQUENCY_HEADS = ("freqs of words that appear", "Times\tnWords")
CSV_HEAD = "Type,xStart,yStart,xEnd,yEnd,strand(f/r),block,length,score,ident,similarity,%ident,SeqX,SeqY"
UNKNOWN = "<unknown>"
_COUNTERS = ("hits", "hits_used", "fragments")
_NUMBERS = ("len_x", "len_y", "lmin", "simthr", *_COUNTERS)


def _info_lines(values: dict[str, Column], credit: str) -> list[Column]:
    """The lines of run information; columns that values lacks, and nulls, are unknown."""
    named = [F.concat(F.lit(f"{label:<21}: "), F.coalesce(values.get(c, F.lit(None)).cast("string"), F.lit(UNKNOWN))) for c, label in LABELS.items()]
    return [F.lit(TITLE), F.lit(credit), *named, F.lit(RULE)]


def write_info(info: DataFrame, path: str, credit: str = "") -> None:
    """info: one row with some of the columns of LABELS. credit: the second line."""
    lines = _info_lines({c: F.col(c) for c in LABELS if c in info.columns}, credit)
    info.select(F.concat_ws("\n", *lines).alias("value")).coalesce(1).write.text(path)


def read_info(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each file, with the columns of LABELS; unknown values are null."""
    text = spark.read.text(paths, wholetext=True)

    def value(label: str) -> Column:
        found = F.trim(F.regexp_extract("value", rf"(?m)^\Q{label}\E *: *(.*)$", 1))
        return F.when(~found.isin("", UNKNOWN), found)

    return text.select(*[(value(label).try_cast("bigint") if c in _NUMBERS else value(label)).alias(c) for c, label in LABELS.items()])


def combined_info(infos: DataFrame) -> DataFrame:
    """The counters of both strands added up for each comparison."""
    return infos.groupBy(*[c for c in LABELS if c not in _COUNTERS]).agg(*[F.sum(c).alias(c) for c in _COUNTERS])


def write_timings(spark: SparkSession, timings: dict[str, float], path: str) -> None:
    """The number of cores, the stages' names and what they took, in minutes and seconds."""
    took = (f"{int(t // 60)}:{t % 60:05.2f}" for t in timings.values())
    lines = ["=" * 35, f"Number of cores: {spark.sparkContext.defaultParallelism}", "=" * 35, ";".join(timings), ";".join(took)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def write_matrix(coverage: DataFrame, path: str) -> None:
    """A line for each length from 0 to LAST_LENGTH, with the counts of 0 to 100 percent, each followed by
    a tab. coverage: len_bin, sim_bin, n."""
    cells = coverage.groupBy("len_bin").pivot("sim_bin", list(range(101))).agg(F.sum("n"))
    lengths = coverage.sparkSession.range(LAST_LENGTH + 1).select(F.col("id").cast("int").alias("len_bin"))
    counts = [F.concat(F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("string"), F.lit("\t")) for i in range(101)]
    lines = lengths.join(F.broadcast(cells), "len_bin", "left")  # a row for each length at most
    lines.repartition(1).sortWithinPartitions("len_bin").select(F.concat(*counts).alias("value")).write.text(path)


def read_matrix(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """len_bin, sim_bin, n of the cells that aren't zero; those of several files are added up."""
    lines = spark.read.text(paths, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("len_bin", "line"))
    cells = lines.select("len_bin", F.posexplode(F.split("line", "\t")).alias("sim_bin", "n")).filter("trim(n) <> ''")
    return cells.groupBy("len_bin", "sim_bin").agg(F.sum(F.col("n").cast("bigint")).alias("n")).filter("n <> 0")


def frequency_report(counts: DataFrame) -> DataFrame:
    """section, key, num, value of a dictionary's counts: words with OUTLIER places or more (number, word and number again), two
    heads, then the number of words for each smaller number of places. In the order of the first three. Words with fewer
    places are summed up before anything is written."""
    spark = counts.sparkSession
    outlier = F.when(F.col("num") >= OUTLIER, F.col("code")).alias("code")
    counts = saved(counts.groupBy(outlier, "num").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    word = packed_word(F.col("code"))
    many = counts.filter(F.col("num") >= OUTLIER).select(F.lit(0).alias("section"), word.alias("key"), "num", F.concat(F.col("num").cast("string"), F.lit("\t"), word, F.col("num").cast("string")).alias("value"))
    heads = spark.createDataFrame([(1, str(i), 0, v) for i, v in enumerate(FREQUENCY_HEADS)], "section int, key string, num bigint, value string")
    few = counts.filter(F.col("num") < OUTLIER)
    return many.unionByName(heads).unionByName(few.select(F.lit(2).alias("section"), F.lit("").alias("key"), "num", F.concat_ws("\t", F.col("num").cast("string"), F.col("n").cast("string")).alias("value")))


def write_frequencies(words: DataFrame, path: str) -> None:
    write_counts(dictionary(words), path)


def write_counts(counts: DataFrame, path: str) -> None:
    """The report of a dictionary's counts."""
    frequency_report(counts).orderBy("section", "key", "num").select("value").write.text(path)


def write_csv_report(exported: DataFrame, path: str, len_x: int, len_y: int, credit: str = "") -> None:
    """Exported fragments below the run information that fragments themselves give; by strand and place."""
    n = exported.count()
    known = {"len_x": F.lit(len_x), "len_y": F.lit(len_y), "fragments": F.lit(n)}
    lines = [*_info_lines(known, credit), F.lit("Total CSB: 0"), F.lit(RULE), F.lit(CSV_HEAD)]
    order = ["section", "strand", "seqX", "seqY", "xStart", "yStart"]
    none = [F.lit(None).cast("bigint").alias(c) for c in order[2:]]
    head = exported.sparkSession.range(1).select(F.posexplode(F.array(*lines)).alias("section", "value")).select("section", F.lit("").alias("strand"), *none, "value")
    rows = exported.select(F.lit(len(lines)).alias("section"), *order[1:], F.concat_ws(",", *[F.col(c).cast("string") for c in exported.columns]).alias("value"))
    head.unionByName(rows).orderBy(*order).select("value").write.text(path)
