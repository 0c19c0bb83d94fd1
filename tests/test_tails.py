"""Tail probabilities as columns against the standard library."""

import math

import numpy as np
from pyspark.sql import functions as F

from valora.operators import evaluate, models


def test_normal_distribution_function(spark):
    zs = [float(z) for z in np.linspace(-14, 14, 2001)] + [0.0, -1e-12, 1e-300, float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(z,) for z in zs], "z DOUBLE").withColumn("p", evaluate.normal_cdf(F.col("z")))
    for r in df.collect():
        assert r.p is None if r.z is None else abs(r.p - math.erfc(-r.z / math.sqrt(2)) / 2) < 1e-13
    tail = spark.createDataFrame([(float(x),) for x in np.linspace(0, 9, 500)], "x DOUBLE").withColumn("e", evaluate.erfc_column(F.col("x")))
    assert all(abs(r.e / math.erfc(r.x) - 1) < 1e-11 for r in tail.collect())


def test_residual_shape_has_no_python_worker_and_is_right(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in np.round(rng.normal(3, 2, 500), 1)] + [("b", float(x)) for x in rng.exponential(1, 300)] + [("c", 1.0)] * 5
    got = models.residual_shape(spark.createDataFrame(rows, "model STRING, r DOUBLE"), "r")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for row in got.collect():
        v = np.sort([x for m, x in rows if m == row.model])
        if row.model == "c":
            assert row.ks is None
            continue
        z = (v - v.mean()) / v.std()
        p = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in z])
        below, upto = np.searchsorted(v, v, "left") / len(v), np.searchsorted(v, v, "right") / len(v)
        assert abs(row.ks - max((p - below).max(), (upto - p).max())) <= 1e-4
        assert abs(row["mean"] - v.mean()) <= 1e-4 and abs(row["sd"] - v.std()) <= 1e-4 and abs(row["skew"] - (z**3).mean()) <= 1e-4


def test_residuals_of_few_cells_are_put_in_order(spark, monkeypatch):
    """The largest gap is found, and the cells that cannot hold it are not ordered."""
    ordered, running = [], models.running_before
    monkeypatch.setattr(models, "running_before", lambda df, keys, *rest: ordered.append(df.count()) or running(df, keys, *rest))
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(0, 1, 8000) ** 3, "b": rng.uniform(-5, 90, 8000), None: rng.exponential(2, 4000)}
    got = models.residual_shape(spark.createDataFrame([(m, float(x)) for m, v in data.items() for x in v], "model STRING, r DOUBLE"), "r").collect()
    assert ordered[-1] < 4000 and len(got) == 3
    for row in got:
        v = np.sort(data[row.model])
        p = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in (v - v.mean()) / v.std()])
        at = np.arange(len(v))
        assert abs(row.ks - max((p - at / len(v)).max(), ((at + 1) / len(v) - p).max())) <= 1e-4
