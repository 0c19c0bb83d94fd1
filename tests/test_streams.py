"""Streams over several batches, restarts and lost progress, by hand."""

import datetime
import shutil
from collections import defaultdict
from statistics import median

from pyspark.sql import functions as F

from valora.operators import models
from valora.streaming import incremental

SCHEMA = "key INT, text STRING"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def enriched(spark, src, dst, name="main"):
    stream = incremental.file_stream(spark, src, SCHEMA, 1)
    incremental.incremental_enrich(spark, stream, lambda b: b.withColumn("size", F.length("text")), dst, "key", name)
    return sorted(map(tuple, incremental.read_batches(spark, dst, f"{SCHEMA}, size INT").collect()))


def test_a_key_is_enriched_once(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, src, [(1, "a"), (2, "bb")])
    arrive(spark, src, [(1, "a2"), (3, "ccc"), (3, "ccc")])  # the next batch of the same run
    want = [(1, "a", 1), (2, "bb", 2), (3, "ccc", 3)]
    assert enriched(spark, src, dst) == want
    arrive(spark, src, [(2, "again"), (4, "d")])  # after a restart
    assert enriched(spark, src, dst) == [*want, (4, "d", 1)]
    other = str(tmp_path / "other")  # another source of the same target
    arrive(spark, other, [(4, "other"), (5, "ee")])
    assert enriched(spark, other, dst, "other") == [*want, (4, "d", 1), (5, "ee", 2)]
    shutil.rmtree(f"{dst}/_progress")  # everything is read again
    assert enriched(spark, src, dst) == [*want, (4, "d", 1), (5, "ee", 2)]


def test_own_batches_are_not_read_again(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, src, [(1, "a")])
    enriched(spark, src, dst)
    folder = next(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=0-"))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], SCHEMA)
    left = incremental._not_elsewhere(rows, dst, "key", folder.removeprefix("batch=0-"))
    assert sorted(r.key for r in left.collect()) == [1, 2]
    assert [r.key for r in incremental._not_elsewhere(rows, dst, "key", "another run").collect()] == [2]


def week_of(t):
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=((t.date() - datetime.date(1970, 1, 1)).days // 7) * 7)


def test_weeks_close_and_late_rows_are_dropped(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: datetime.datetime(2024, 1, 4) + datetime.timedelta(days=d)  # noqa: E731 - a Thursday, when weeks start
    steps = [
        [("a", day(0), 1.0), ("a", day(1), 5.0), ("a", day(2), 5.0), ("b", day(3), 2.0), ("b", day(3), None)],
        [("a", day(6), 9.0), ("a", day(8), 1.0), ("b", day(10), 4.0)],  # 10 days: past the end of the first week and the delay
        [("a", day(1), 100.0), ("a", day(9), 3.0), ("b", day(30), 7.0)],  # the first row is late
        [("b", day(12), 8.0), ("a", day(31), 1.0)],  # late again
    ]
    schema, seen, kept = "zone STRING, t TIMESTAMP, v DOUBLE", None, defaultdict(list)
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.market_pulse_stream(spark, incremental.file_stream(spark, src, schema), dst, "zone", "t", "v")
        mark = seen and seen - datetime.timedelta(days=2)
        for zone, t, v in rows:
            if v is not None and (mark is None or datetime.datetime.combine(week_of(t), datetime.time()) + datetime.timedelta(days=7) > mark):
                kept[zone, week_of(t)].append(v)
        seen = max([t for _, t, v in rows if v is not None] + ([seen] if seen else []))
    closed = {k: (median(v), len(v)) for k, v in kept.items()
              if datetime.datetime.combine(k[1], datetime.time()) + datetime.timedelta(days=7) <= seen - datetime.timedelta(days=2)}
    got = incremental.read_batches(spark, dst, "zone STRING, week TIMESTAMP, median DOUBLE, n BIGINT").collect()
    assert {(r.zone, r.week.date()): (r.median, r.n) for r in got} == closed and len(got) == len(closed) == 4
    assert closed["a", datetime.date(2024, 1, 4)] == (5.0, 4) and kept["b", datetime.date(2024, 2, 1)]


def test_weighted_median_of_hot_and_small_groups(spark):
    rows = [("x", float(v % 17), 1 + v % 5) for v in range(17)] + [("y", 3.0, 2), ("z", 1.0, 1), ("z", 2.0, 1), ("w", 1.0, 10_000_000_000), ("w", 2.0, 1)]
    got = incremental.weighted_median(spark.createDataFrame(rows, "g STRING, v DOUBLE, k LONG"), ["g"], "v", "k").collect()
    want = median([v for g, v, k in rows if g == "x" for _ in range(k)])
    assert {r.g: r.median for r in got} == {"x": want, "y": 3.0, "z": 1.5, "w": 1.0}


def test_streams_score_with_the_saved_model(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "cast(id % 7 as double) AS a", "cast(1000 + 50 * (id % 7) as double) AS price").withColumn("label", F.log1p("price"))
    model = models.fit(rows, ["a"], models.linear(), "log1p")
    models.save_model(model, spark, str(tmp_path / "model"))
    rows.select("id", "a", "price").repartition(5).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), "id LONG, a DOUBLE, price DOUBLE")
    incremental.stream_score(spark, stream, str(tmp_path / "model"), str(tmp_path / "out"))
    got = {r.id: r.estimate for r in incremental.read_batches(spark, str(tmp_path / "out"), "id LONG, estimate DOUBLE").collect()}
    assert got == {r.id: r.estimate for r in model.score(rows).collect()}
