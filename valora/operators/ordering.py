"""Row numbers and running totals over whole tables or hot groups, without a one-task window.

A window ordered over a whole group sorts that group in one task. Here splitters from a bounded
hashed sample cut every group into ordered bins; bin totals give each bin its offset, and the
window runs inside (group, bin) only. The order must be total (end it with a unique key).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valora.operators.quantile import attach
from valora.session import materialize

SAMPLE_PER_BIN = 32


def bin_count(df: DataFrame) -> int:
    """As many bins as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_bins(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bins: int | None = None) -> DataFrame:
    """Add ``__ord`` (the order as one struct) and ``__bin`` (its bin inside the group)."""
    keys = list(keys)
    bins = bins or bin_count(df)
    rows = df.withColumn("__ord", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    sample = SAMPLE_PER_BIN * bins
    picked = rows.select(*keys, "__ord", F.xxhash64("__ord").alias("__h"))
    if keys:
        w = W.partitionBy(*keys).orderBy("__h", "__ord")
        picked = picked.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= sample)
    else:
        picked = picked.orderBy("__h", "__ord").limit(sample)
    sorted_sample = F.array_sort(F.collect_list("__ord"))
    every = SAMPLE_PER_BIN
    split = F.filter(sorted_sample, lambda x, i: (i % every) == every - 1)
    # Every stride-th splitter comes first, so a row meets about twice the root of the bins.
    stride = math.isqrt(bins) + 1
    coarse = F.filter("__all", lambda x, i: (i % stride) == stride - 1)
    splits = picked.groupBy(*keys).agg(split.alias("__all")).select(*keys, F.struct("__all", coarse.alias("__coarse")).alias("__splits"))
    if keys:
        placed = attach(rows, splits, keys)
    else:
        placed = rows.withColumn("__splits", materialize(splits, "splits").scalar())
    before = F.size(F.filter("__splits.__coarse", lambda s: s < F.col("__ord"))) * stride
    near = F.slice("__splits.__all", before + 1, F.lit(stride))
    position = before + F.size(F.filter(near, lambda s: s < F.col("__ord")))
    return placed.withColumn("__bin", F.coalesce(position, F.lit(0))).drop("__splits")


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    weight: Column | None = None,
    out: str = "before",
    bins: int | None = None,
) -> DataFrame:
    """Add the total weight of the rows that come earlier in the group."""
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    rows = with_bins(df.withColumn("__w", w.cast("bigint")), keys, order, bins)
    totals = rows.groupBy(*keys, "__bin").agg(F.sum("__w").alias("__t"))
    over = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__bin")
    totals = totals.withColumn(
        "__off", F.coalesce(F.sum("__t").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("__t")
    rows = attach(rows, totals, [*keys, "__bin"])
    inner = W.partitionBy(*keys, "__bin").orderBy("__ord").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.col("__off") + F.coalesce(F.sum("__w").over(inner), F.lit(0)))
    return rows.drop("__w", "__ord", "__bin", "__off")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """1-based row number of every row, over all rows of the group."""
    return running_before(df, keys, order, out="__before").withColumn(out, F.col("__before") + 1).drop("__before")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each group; the limit is applied before the shuffle, so a hot group is
    reduced to ``k`` rows per input partition first."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key (NULL keys form one group), combining on the map side."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(f"__row.{c}").alias(c) for c in cols])
