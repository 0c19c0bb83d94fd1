"""Incremental work: merging new sources, enriching what is new, scoring streams.

Batch and stream share the same steps. Streams run with ``availableNow`` and keep their progress in the
folder of their results, by source folder (``name``), so a restarted query continues where it stopped.
A batch folder carries the id of its progress: where that was deleted, nothing written before is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from valora.operators.joins import pending
from valora.operators.models import load_model
from valora.operators.ordering import first_by, running_before
from valora.operators.quantile import attach
from valora.operators.segment import valuation_flags
from valora.operators.select import valid_price
from valora.session import materialize

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def union_sources(*frames: DataFrame) -> DataFrame:
    """Stack sources by column name; a column a source lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row per key; rows without a key count as one group."""
    return first_by(df, [key], [F.col(o) for o in order])


def weekly_merge(base: DataFrame, *new: DataFrame, key: str = "source_url", order: Sequence[str] = ("source_prio", "listing_id")) -> DataFrame:
    """Base before new sources, one row per key, priced rows only."""
    frames = [f.withColumn("source_prio", F.lit(i)) for i, f in enumerate((base, *new))]
    return valid_price(dedupe_first(union_sources(*frames), key, order)).drop("source_prio")


def skip_finished(units: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    return pending(units, metrics, key)


def _run(stream: DataFrame, spark: SparkSession, target: str, name: str, each: Callable[[DataFrame, str, str], None]) -> None:
    """Run ``each`` on every batch with the id of the run and the name of the batch's folder."""
    progress = f"{target}/_progress/{name}"
    # State of every key ever seen does not fit into memory: it lies on disk and is kept with the progress.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def step(batch: DataFrame, batch_id: int) -> None:
        run = json.loads(batch.sparkSession.read.text(f"{progress}/metadata").first()[0])["id"]
        each(batch, run, f"batch={batch_id}-{run}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _not_elsewhere(batch: DataFrame, target: str, key: str, run: str) -> DataFrame:
    """Rows whose key no other run wrote to the target; the keys of this run are in its state.

    The filter on the path prunes files when they are listed: what this run wrote is not read again.
    """
    key_field = StructType([batch.schema[key]])
    done = batch.sparkSession.read.schema(key_field).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).parquet(target)
    return pending(batch, done.where(~F.col("_metadata.file_path").contains(f"-{run}/")), key)


def _ready(spark: SparkSession, target: str, schema: StructType) -> None:
    """An empty first table, so that every batch finds one."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/batch=-1")


def stream_merge(spark: SparkSession, source: DataFrame, target: str, key: str, name: str = "main") -> None:
    """Append the rows of a stream whose key is not in the target yet.

    One state entry per key, kept with the progress, tells which keys came before, in this batch or any
    earlier one, also after a restart; of several rows of a key in one batch any one stays, and rows without
    a key count as one key. Only what other sources (or a run whose progress was deleted) wrote to the target
    is read, for an anti-join. Every batch writes its own folder and replaces it when it is run again, so a batch
    that is repeated after a failure adds nothing twice.
    """
    def append(batch: DataFrame, run: str, folder: str) -> None:
        _not_elsewhere(batch, target, key, run).write.mode("overwrite").parquet(f"{target}/{folder}")

    _ready(spark, target, source.schema)
    _run(source.dropDuplicates([key]), spark, target, name, append)


def incremental_enrich(spark: SparkSession, source: DataFrame, enrich: Callable[[DataFrame], DataFrame], target: str, key: str, name: str = "main") -> None:
    """Enrich every key once: rows whose key was enriched before, in any batch or run, are passed over.

    As in :func:`stream_merge`, the stream's state holds the keys of this source, and an anti-join those that
    others enriched. ``enrich`` keeps the column ``key``.
    """
    def step(batch: DataFrame, run: str, folder: str) -> None:
        enrich(_not_elsewhere(batch, target, key, run)).write.mode("overwrite").parquet(f"{target}/{folder}")

    _ready(spark, target, StructType([source.schema[key]]))
    _run(source.dropDuplicates([key]), spark, target, name, step)


def stream_score(spark: SparkSession, source: DataFrame, model_path: str, target: str, pct: float = 20.0, name: str = "main") -> None:
    """Score arriving listings with the model saved at ``model_path`` and flag those far from the estimate."""
    model = load_model(spark, model_path)

    def step(batch: DataFrame, run: str, folder: str) -> None:
        valuation_flags(model.score(batch), pct=pct).write.mode("overwrite").parquet(f"{target}/{folder}")

    _run(source, spark, target, name, step)


def read_batches(spark: SparkSession, target: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target)


def market_pulse(df: DataFrame, zone: str, time: str, value: str) -> DataFrame:
    """Rows and exact median per zone and week."""
    from valora.operators.quantile import exact_quantiles

    rows = df.withColumn("week", F.window(F.col(time).cast("timestamp"), "7 days")["start"])
    return exact_quantiles(rows, [zone, "week"], value, {"median": 0.5})


def market_pulse_stream(spark: SparkSession, source: DataFrame, target: str, zone: str, time: str, value: str, delay: str = "2 days",
                        name: str = "main") -> None:
    """Append each week of each zone when it closes: rows and exact median, late rows left out.

    The state of an open week holds its distinct values with their counts, not its rows. A week closes when the
    latest time seen, less ``delay``, passes its end: all its counts come out in that batch, and the median
    is read off their running totals. Rows of a week that is closed already are dropped; open weeks wait
    for more data. Rows without a value or a time count for nothing.
    """
    counted = (
        source.where(F.col(value).isNotNull()).withWatermark(time, delay)
        .groupBy(F.col(zone), F.window(time, "7 days").alias("w"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
        .select(zone, F.col("w.start").alias("week"), "v", "k")
    )

    def step(batch: DataFrame, run: str, folder: str) -> None:
        weighted_median(materialize(batch, "closed-weeks"), [zone, "week"], "v", "k").write.mode("overwrite").parquet(f"{target}/{folder}")

    _run(counted, spark, target, name, step)


def weighted_median(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Exact median of each group of (value, count) rows with distinct values, and the rows they stand for."""
    total = materialize(counts.groupBy(*keys).agg(F.sum(count).alias("n")), "totals")
    placed = attach(running_before(counts, keys, [F.col(value)], F.col(count)), total, keys)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda at: F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col(count)), F.col(value)))
    return placed.groupBy(*keys).agg(((holds(low) + holds(high)) / 2).alias("median"), F.max("n").alias("n"))
