"""Helpers the operators of this package share."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.session import materialize, scratch_path, tune

__all__ = ["materialize", "prepare", "scratch_path", "store", "table", "text_or_empty", "union_roots"]


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Python batches small enough for very long texts."""
    tune(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def store(uri: str):
    """File system and path of a shared folder, for tasks that write or read a format of their own."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def union_roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the trees of linked items in place; every root is the smallest index of its tree."""
    while len(left):
        left, right = _root(parent, left), _root(parent, right)
        apart = left != right
        left, right = left[apart], right[apart]
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))


def _root(parent: np.ndarray, items: np.ndarray) -> np.ndarray:
    up = parent[items]
    while True:
        top = parent[up]
        if np.array_equal(top, up):
            parent[items] = up
            return up
        up = top
