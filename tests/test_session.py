"""Intermediate tables go when their block ends."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from valora.session import materialize, scratch_root, temporary_tables


def stored(spark):
    root = Path(scratch_root(spark).removeprefix("file:")) / "valora"
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_tables_go_with_their_block(spark):
    before = stored(spark)
    with temporary_tables(spark) as keep:
        one = materialize(spark.range(10).toDF("x"), "one")
        with temporary_tables(spark) as inner:
            two = inner(materialize(one.where("x > 3"), "two"), "three")
        assert two.count() == 6 and len(stored(spark) - before) == 2
        kept = keep(two.withColumn("y", F.col("x") * 2), "kept")
    assert [n.split("-")[0] for n in stored(spark) - before] == ["kept"] and kept.count() == 6
    after = stored(spark)
    with pytest.raises(ZeroDivisionError), temporary_tables(spark):
        materialize(one.sparkSession.range(3).toDF("x"), "four")
        1 / 0
    assert stored(spark) == after
    materialize(spark.range(3).toDF("x"), "outside")
    assert len(stored(spark)) == len(after) + 1


def test_stored_tables_leave_no_shuffle_files(spark):
    """They filled the disk: files of finished steps stayed until the driver collected its garbage."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in map(manager.getAllFiles().apply, range(manager.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = files()
    with temporary_tables(spark):
        counts = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert not files() - before
        assert counts.count() == 7
