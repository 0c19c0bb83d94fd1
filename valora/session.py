"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; all can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "valora", cpus: str | int = 8, partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("VALORA_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # The test files are small: keep their partitions apart so that all cores work.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.debug.maxToStringFields", "200")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the cluster.

    Only in local mode, where the setting may be absent, a fresh local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark, "_valora_scratch", None)
        if not root:
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark._valora_scratch = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/valora/{label}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A path of the shared folder that goes with the block of :func:`temporary_tables` it is made in."""
    path = scratch_path(spark, label)
    if scopes := getattr(spark, "_valora_scopes", None):
        scopes[-1].append(path)
    return path


def file_system(uri: str):
    """File system and path of a shared folder, for tasks that write or read files of their own."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives the optimizer the
    true size of the result, so that a join against it is broadcast only when the files on disk
    are below ``spark.sql.autoBroadcastJoinThreshold`` and is a shuffled (skew-split) join beyond.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    with shuffles_dropped(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables that :func:`materialize` stores inside the block when it ends, also when it fails.

    What is yielded stores a table that stays. Results that are still to be computed from deleted tables are
    lost: write them, or store them with what is yielded, before the block ends.
    """
    scopes = spark.__dict__.setdefault("_valora_scopes", [])
    mine: list[str] = []
    scopes.append(mine)

    def keep(df: DataFrame, label: str = "table") -> DataFrame:
        out = materialize(df, label)
        path = scopes[-1].pop()
        # It belongs to the block around this one, if there is any.
        around = next(i for i, s in enumerate(scopes) if s is mine)
        if around:
            scopes[around - 1].append(path)
        return out

    try:
        yield keep
    finally:
        scopes.pop()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, mine):
            path.getFileSystem(conf).delete(path, True)
