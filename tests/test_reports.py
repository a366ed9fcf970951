"""Text reports, line by line."""

from pyspark.sql import functions as F
from test_operators import S32, S40, genome

from strandmill.operators import dictionary, kmers
from strandmill.plans.compare import Comparison
from strandmill.sources import reports


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_info(spark, tmp_path):
    row = spark.createDataFrame([("x.fasta", 40, 1, 7)], "file_x string, len_x bigint, hits bigint, fragments bigint")
    path = tmp_path / "info"
    reports.write_info(row, f"file://{path}", "someone")
    found = lines(path)
    assert len(found) == 14 and found[1] == "someone" and found[2] == "SeqX filename        : x.fasta"
    assert found[11] == "Tot Hits (seeds) used: <unknown>" and found[12] == "Total fragments      : 7"
    read = reports.read_info(spark, [f"file://{path}", f"file://{path}"])
    assert read.count() == 2
    one = reports.combined_info(read).first()
    assert (one.file_x, one.name_x, one.len_x, one.hits, one.hits_used, one.fragments) == ("x.fasta", None, 40, 2, None, 14)


def test_matrix(spark, tmp_path):
    kind = "len_bin int, sim_bin int, n bigint"
    cells = [(0, 0, 3), (40, 96, 1), (999, 100, 12)]
    reports.write_matrix(spark.createDataFrame(cells, kind), f"file://{tmp_path}/m")
    found = lines(tmp_path / "m")
    assert len(found) == 1000 and all(x.count("\t") == 101 for x in found) and found[999].endswith("\t12\t")
    assert sorted(map(tuple, reports.read_matrix(spark, f"file://{tmp_path}/m").collect())) == cells
    reports.write_matrix(spark.createDataFrame([], kind), f"file://{tmp_path}/none")
    both = reports.read_matrix(spark, [f"file://{tmp_path}/m", f"file://{tmp_path}/none", f"file://{tmp_path}/m"])
    assert sorted(map(tuple, both.collect())) == [(a, b, 2 * n) for a, b, n in cells]


def test_frequencies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "OUTLIER", 3)
    words = kmers.kmers(genome(spark, S32, S32, S32, S40))
    reports.write_frequencies(words, f"file://{tmp_path}/f")
    assert lines(tmp_path / "f") == [f"4\t{S32}4", *reports.FREQUENCY_HEADS, "1\t8"]
    reports.write_frequencies(words.filter("false"), f"file://{tmp_path}/none")
    assert lines(tmp_path / "none") == list(reports.FREQUENCY_HEADS)
    assert dictionary.OUTLIER == 1001


def test_timings(spark, tmp_path):
    g = genome(spark, S40)
    c = Comparison(g, g, lmin=30, strands="f")
    c.fragments.count()
    assert list(c.timings) == ["hits", "thinned", "used"] and all(t > 0 for t in c.timings.values())
    reports.write_timings(spark, {"hits": 75.5, "used": 0.25}, f"file://{tmp_path}/t")
    assert lines(tmp_path / "t") == ["=" * 35, f"Number of cores: {spark.sparkContext.defaultParallelism}", "=" * 35, "hits;used", "1:15.50;0:00.25"]


def test_csv_report(spark, tmp_path):
    g = genome(spark, S40)
    c = Comparison(g, g, lmin=30, strands="f")
    reports.write_csv_report(c.exported, f"file://{tmp_path}/c", 40, 40)
    found = lines(tmp_path / "c")
    assert len(found) == 18 and found[0] == reports.TITLE and found[6] == "SeqX length          : 40" and found[12] == "Total fragments      : 1"
    assert found[16:] == [reports.CSV_HEAD, "Frag,0,0,39,39,f,0,40,160,40,1.00,1.00,0,0"]


def test_frequencies_write_no_dictionary(spark, monkeypatch, tmp_path):
    """Of words below the outliers only their numbers are written."""
    counts = spark.range(5000).select(F.col("id").alias("code"), F.when(F.col("id") < 3, 2000).otherwise(F.pmod("id", F.lit(4)) + 1).cast("bigint").alias("num"))
    rows = []

    def kept(df, name):
        rows.append(df.count())
        return df

    monkeypatch.setattr(reports, "saved", kept)
    reports.write_counts(counts, f"file://{tmp_path}/f")
    assert rows == [7] and spark.read.text(f"file://{tmp_path}/f").count() == 9
