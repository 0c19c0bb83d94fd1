"""Bootstrap resamples against the same draws made one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.operators import sampling

MASK = (1 << 64) - 1


def one_weight(seed, b):
    x = (seed + (b + 1) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    x ^= x >> 31
    return sum(int(c) <= x for c in sampling.poisson_cuts())


def brute(rows, b):
    """Sums of weights and of weighted values in plain Python."""
    return [(sum(w := [one_weight(s, i) for s, _ in rows]), sum(x * v for x, (_, v) in zip(w, rows))) for i in range(b)]


def test_weights_are_poisson_with_a_whole_tail():
    cuts = sampling.poisson_cuts()
    assert len(cuts) >= 19 and (np.diff(cuts.astype(object)) > 0).all()
    assert float(cuts[0]) / 2**64 == pytest.approx(math.exp(-1), rel=1e-15)
    w = sampling.poisson_weights(np.arange(500, dtype=np.uint64) * 977, 0, 2000)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert w[3, 1717] == one_weight(3 * 977, 1717)
    # The extremes of the 64-bit range.
    high = sampling._by_high_bits()
    assert high[0] == 0 and (high == sampling.UNSURE).sum() <= len(cuts) and high[-1] == sampling.UNSURE


def test_same_draws_one_by_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(50, 9, 70))], "id INT, v DOUBLE")
    seeded = [(r.s & MASK, r.v) for r in df.select(F.xxhash64(F.col("id").cast("string"), F.lit(42)).alias("s"), "v").collect()]
    sums = {r.b: (r.n, r.v) for r in sampling.resampled_sums(df, "id", {"v": F.col("v")}, 1100, 42).collect()}
    want = brute(seeded, 1100)
    assert all(sums[b] == (n, pytest.approx(v, rel=1e-12)) for b, (n, v) in enumerate(want)) and len(sums) == 1100
    means = sorted(v / n for n, v in want)
    got = sampling.bootstrap_ci(df, "id", "v", 1100).first()
    assert (got.lo, got.hi, got.n) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)), 1100)


def test_regression_intervals(spark):
    rng = np.random.default_rng(5)
    y = rng.uniform(10, 90, 60)
    p = y + rng.normal(0, 6, 60)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [(60, 5.0, None)], "id INT, y DOUBLE, p DOUBLE")
    got = {r.metric: (r.lo, r.hi) for r in sampling.bootstrap_regression(df, "id", "y", "p").collect()}
    seeds = np.array([r.s for r in df.select("id", F.xxhash64(F.col("id").cast("string"), F.lit(42)).alias("s")).orderBy("id").collect()][:60]).view(np.uint64)
    w = sampling.poisson_weights(seeds, 0, 10_000).astype(float)
    n, e = w.sum(axis=0), (y - p)[:, None]
    mae = (w * np.abs(e)).sum(axis=0) / n
    mean = (w * y[:, None]).sum(axis=0) / n
    r2 = 1 - (w * e * e).sum(axis=0) / (w * (y[:, None] - mean) ** 2).sum(axis=0)
    for name, values in (("mae", mae), ("r2", r2)):
        assert got[name] == (pytest.approx(np.quantile(values, 0.025)), pytest.approx(np.quantile(values, 0.975)))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id INT, v DOUBLE")
    assert sampling.bootstrap_means(empty, "id", "v", 10, 1).count() == 0


def test_undecided_draws_take_the_last_mixing_step():
    """Draws whose upper bits do not tell their weight, among many."""
    seeds = np.arange(40, dtype=np.uint64) * np.uint64(0x5DEECE66D)
    w = sampling.poisson_weights(seeds, 7, 2007)
    assert w.dtype == np.uint8 and w.max() < sampling.UNSURE
    assert all(w[i, b] == one_weight(int(seeds[i]), b + 7) for i in range(40) for b in range(2000))
