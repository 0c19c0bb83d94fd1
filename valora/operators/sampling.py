"""Splits, folds, samples and bootstraps, all keyed on a portable hash of the row key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import col, unit_hash
from valora.operators.ordering import numbered
from valora.operators.quantile import exact_quantiles
from valora.session import materialize


def split2(key: str | Column, seed: int, train: float = 0.8) -> Column:
    return F.when(unit_hash(key, seed) < train, "train").otherwise("test")


def split3(key: str | Column, seed: int, train: float = 0.8, valid: float = 0.1) -> Column:
    u = unit_hash(key, seed)
    return F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")


def kfold(key: str | Column, k: int, seed: object) -> Column:
    return F.floor(unit_hash(key, seed) * k).cast("int")


def repeated_kfold(df: DataFrame, key: str, k: int, repeats: int, seed: int) -> DataFrame:
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return reps.withColumn("fold", kfold(key, k, F.col("rep") + seed))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows: the smallest hashes (a distributed top-n)."""
    return df.orderBy(unit_hash(key, seed), key).limit(n)


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(unit_hash(key, seed), key)


def renumber(df: DataFrame, key: str, seed: int, out: str = "id_seq") -> DataFrame:
    """Consecutive numbers in shuffled order."""
    return numbered(df, [], [unit_hash(key, seed), F.col(key)], out)


def nested_subsets(df: DataFrame, key: str, sizes: Sequence[int], seed: int) -> DataFrame:
    """The first n rows in shuffled order, for each n; smaller subsets are inside larger ones."""
    top = sample_n(df, key, max(sizes), seed)
    ranked = numbered(top, [], [unit_hash(key, seed), F.col(key)], "rank")
    sized = ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return sized.filter(F.col("rank") <= F.col("size"))


# ---- bootstrap ----------------------------------------------------------------------------
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # the step of the counter
RESAMPLES, ROWS = 512, 128  # weights drawn at a time
UNSURE = 255


@cache
def poisson_cuts() -> np.ndarray:
    """Ends of the Poisson(1) distribution function on 64-bit integers; a draw's weight is the number of ends up to it."""
    total, term, cuts = Decimal(0), Decimal(-1).exp(), []
    while (total := total + term) * 2**64 < 2**64 - 1:
        cuts.append(int(total * 2**64))
        term /= len(cuts)
    return np.array(cuts, dtype=np.uint64)


def poisson_weights(seeds: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights of the rows with these 64-bit seeds in the resamples from ``first`` up to ``last``: the bits of
    draw b of a row are its seed plus (b + 1) steps, mixed."""
    x = seeds.astype(np.uint64)[:, None] + np.arange(first + 1, last + 1, dtype=np.uint64) * GOLDEN
    shifted = np.empty_like(x)
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(bits), out=shifted)
        np.bitwise_xor(x, shifted, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    # The last step, x ^= x >> 31, leaves the upper bits as they are: only what they do not decide takes it.
    np.right_shift(x, np.uint64(48), out=shifted)
    weights = np.empty(x.shape, dtype=np.uint8)
    np.take(_by_high_bits(), shifted.view(np.int64), out=weights, mode="clip")
    # Few rows hold an unsure draw, and a maximum costs less than a search for it.
    some = np.flatnonzero(weights.max(axis=1, initial=0) == UNSURE)
    row, at = np.nonzero(weights[some] == UNSURE)
    rest = x[some[row], at]
    weights[some[row], at] = np.searchsorted(poisson_cuts(), rest ^ (rest >> np.uint64(31)), side="right")
    return weights


@cache
def _by_high_bits() -> np.ndarray:
    """Weight by the upper 16 bits; ``UNSURE`` where the others decide."""
    low = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    least, most = (np.searchsorted(poisson_cuts(), x, side="right") for x in (low, low | np.uint64((1 << 48) - 1)))
    return np.where(least == most, least, UNSURE).astype(np.uint8)


def resampled_sums(df: DataFrame, key: str, values: dict[str, Column], b: int, seed: int) -> DataFrame:
    """One row per resample: b, n (sum of weights) and the weighted sum of each value.

    Every row's seed is a hash of its key; its ``b`` Poisson(1) weights are drawn from a counter where the row
    lies. Each task adds them into ``b`` partial sums, a matrix product of a few rows at a time, and sends only
    those. Rows with a null value must be left out before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("seed"), *[v.cast("double").alias(n) for n, v in values.items()])
    names = list(values)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names) + 1, b))
        for batch in batches:
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            table = np.stack([np.ones(len(seeds)), *[batch.column(n).to_numpy() for n in names]])
            for lo in range(0, len(seeds), ROWS):
                some = slice(lo, lo + ROWS)
                for first in range(0, b, RESAMPLES):
                    last = min(b, first + RESAMPLES)
                    sums[:, first:last] += table[:, some] @ poisson_weights(seeds[some], first, last).astype(np.float64)
        if sums[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(b)), *[pa.array(s) for s in sums]], names=["b", "n", *names])

    # The work is b times the rows: narrow rows are dealt evenly to as many tasks as there are partitions.
    drawn = rows.repartition(parts).mapInArrow(draw, ", ".join(["b long", "n double", *[f"`{n}` double" for n in names]]))
    return drawn.groupBy("b").agg(*[F.sum(n).alias(n) for n in ("n", *names)])


def bootstrap_means(df: DataFrame, key: str, value: str, b: int, seed: int) -> DataFrame:
    """Mean of each resample; rows without a value are left out."""
    rows = df.select(key, col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    sums = resampled_sums(rows, key, {"v": F.col("v")}, b, seed)
    return sums.filter("n > 0").select("b", (F.col("v") / F.col("n")).alias("stat"))


def bootstrap_ci(df: DataFrame, key: str, value: str, b: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean."""
    means = materialize(bootstrap_means(df, key, value, b, seed), "resamples")
    return exact_quantiles(means, [], "stat", {"lo": alpha / 2, "hi": 1 - alpha / 2})


def bootstrap_regression(df: DataFrame, key: str, y: str, yhat: str, b: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Intervals of MAE and R² from the same resamples."""
    rows = df.select(key, F.col(y).alias("y"), (F.col(y) - F.col(yhat)).alias("e")).filter("y IS NOT NULL AND e IS NOT NULL")
    e, real = F.col("e"), F.col("y")
    sums = resampled_sums(rows, key, {"ae": F.abs(e), "se": e * e, "sy": real, "syy": real * real}, b, seed)
    stats = sums.filter("n > 0").select(
        F.explode(F.array(
            F.struct(F.lit("mae").alias("metric"), (F.col("ae") / F.col("n")).alias("v")),
            F.struct(F.lit("r2").alias("metric"), (1 - F.col("se") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("v")),
        )).alias("s")
    ).select("s.*")
    return exact_quantiles(materialize(stats, "resamples"), ["metric"], "v", {"lo": alpha / 2, "hi": 1 - alpha / 2})
