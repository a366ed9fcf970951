"""The fragment files' data source: ranges of records, and what failed tasks leave."""

import pytest
from pyspark.sql import functions as F

from strandmill.sources import fragment_files


def rows_of(spark, n):
    names = [c.split() for c in fragment_files.SCHEMA.split(", ")]
    values = {"strand": F.when(F.col("id") % 3 == 0, "r").otherwise("f"), "similarity": (F.col("id") / 7).cast("float"), "length": F.when(F.col("id") % 10 == 9, 0).otherwise(F.col("id") + 1)}
    return spark.range(n).select(*[values.get(c, F.col("id") * (k - 3)).cast(t).alias(c) for k, (c, t) in enumerate(names)])


def told(df):
    return sorted(map(tuple, df.collect()))


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = rows_of(spark, 5000)
    path = f"file://{tmp_path}/f"
    fragment_files.write_fragments(rows.coalesce(1), 7, 9, path)
    (file,) = (tmp_path / "f").iterdir()
    assert file.stat().st_size == 16 + 93 * 5000
    whole = told(rows.filter("length > 0"))
    for split, tasks in ((64 << 20, 1), (93 * 600, 9), (10, 5000)):
        read = fragment_files.read_fragment_files(spark, f"{path}/{file.name}", split) if split != 10 else None
        if read is not None:
            assert read.rdd.getNumPartitions() == tasks and told(read) == whole
    assert len(fragment_files.FragmentReader(path, 10).partitions()) == 5000
    assert told(fragment_files.read_fragment_files(spark, path).select("strand", "diag")) == sorted((t[-1], t[0]) for t in whole)


def test_many_tasks_write(spark, tmp_path):
    rows = rows_of(spark, 999).repartition(6)
    path = f"file://{tmp_path}/f"
    fragment_files.write_fragments(rows, 7, 9, path)
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == [f"part-{k:06d}.frags" for k in range(6)]
    assert told(fragment_files.read_fragment_files(spark, path)) == told(rows.filter("length > 0"))


def test_a_failed_job_leaves_nothing_to_read(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    broken = rows_of(spark, 400).repartition(4).withColumn("strand", F.when(F.col("diag") == -3 * 77, F.raise_error(F.lit("broken"))).otherwise(F.col("strand")))
    with pytest.raises(Exception, match="broken"):
        fragment_files.write_fragments(broken, 7, 9, path)
    assert not [p for p in (tmp_path / "f").iterdir() if not p.name.startswith(".")]
    assert fragment_files.read_fragment_files(spark, path).count() == 0
