"""Boosted trees against a learner that tries every split row by row."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from valora.operators import boosting, models
from valora.operators.boosting import Settings
from valora.plans.catalog import QUERIES


def soft(g, alpha):
    return math.copysign(max(abs(g) - alpha, 0.0), g)


def brute_tree(rows, grads, s, level=0):
    """A function from a row to its leaf's value."""
    g, n = sum(grads), len(rows)
    score = lambda a, b: soft(a, s.alpha) ** 2 / (b + s.lam)
    leaf = -soft(g, s.alpha) / (n + s.lam) * s.step
    best = None
    for f in range(len(rows[0])) if level < s.depth else ():
        for cut in sorted({r[f] for r in rows if r[f] is not None}) + [math.inf]:
            for missing_left in (False, True):
                left = [i for i, r in enumerate(rows) if (missing_left if r[f] is None else r[f] < cut)]
                if not s.min_rows <= len(left) <= n - s.min_rows:
                    continue
                gl = sum(grads[i] for i in left)
                gain = (score(gl, len(left)) + score(g - gl, n - len(left)) - score(g, n)) / 2
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, cut, missing_left, left
    if best is None:
        return lambda r: leaf
    _, f, cut, missing_left, left = best
    inside = set(left)
    right = [i for i in range(n) if i not in inside]
    a, b = (brute_tree([rows[i] for i in half], [grads[i] for i in half], s, level + 1) for half in (left, right))
    return lambda r: (a if (missing_left if r[f] is None else r[f] < cut) else b)(r)


def brute_predictions(rows, labels, s):
    base = sum(labels) / len(labels)
    pred = [base] * len(rows)
    for _ in range(s.trees):
        tree = brute_tree(rows, [p - y for p, y in zip(pred, labels)], s)
        pred = [p + tree(r) for p, r in zip(pred, rows)]
    return pred


def sample(n=160, missing=0.0):
    rng = random.Random(11)
    rows = [[float(rng.randrange(14)), rng.randrange(40) / 3, float(rng.random() < 0.3)] for _ in range(n)]
    labels = [math.sin(r[0]) * 3 + r[1] * 0.4 + 2 * r[2] * (r[0] > 6) + rng.gauss(0, 0.3) for r in rows]
    return [[None if rng.random() < missing else v for v in r] for r in rows], labels


def fitted(spark, rows, labels, s, parts=3):
    df = spark.createDataFrame([(i, r, y) for i, (r, y) in enumerate(zip(rows, labels))], "id long, x array<double>, y double").repartition(parts)
    base, trees, gains = boosting.fit_trees(df, F.col("x"), F.col("y"), F.col("id"), len(rows[0]), s)
    x = boosting.np.array([[math.nan if v is None else v for v in r] for r in rows])
    return base + sum(t.value[t.place(x, False)] for t in trees), trees, gains


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_same_predictions_as_brute_force(spark, missing):
    rows, labels = sample(missing=missing)
    s = Settings(trees=4, depth=3, step=0.3, rows=1.0, features=1.0, bins=250)
    got, _, gains = fitted(spark, rows, labels, s)
    assert got.tolist() == pytest.approx(brute_predictions(rows, labels, s), abs=1e-6)
    assert (gains > 0).all()


def test_partitions_and_stored_predictions_leave_the_model_alone(spark, monkeypatch):
    rows, labels = sample()
    s = Settings(trees=5, depth=3, step=0.3)
    one, trees, _ = fitted(spark, rows, labels, s, 1)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    five, again, _ = fitted(spark, rows, labels, s, 5)
    assert one.tolist() == five.tolist()
    assert [t.pack() for t in trees] == [t.pack() for t in again]
    assert len({tuple(sorted(set(t.feature.tolist()) - {-1})) for t in trees}) > 1  # trees see different features


def test_penalties_shrink_leaves(spark):
    rows, labels = sample()
    size = lambda **k: max(abs(v) for v in fitted(spark, rows, labels, Settings(trees=1, depth=2, step=1.0, rows=1.0, features=1.0, **k))[1][0].value)
    assert size(lam=50.0) < size(lam=1.0)
    assert size(alpha=1e9) == 0.0


def test_edges(spark):
    with pytest.raises(ValueError, match="no labelled rows"):
        fitted(spark, [[1.0]], [None], Settings(trees=1))
    got, trees, _ = fitted(spark, [[1.0], [1.0], [None]], [5.0, 5.0, 5.0], Settings(trees=1))
    assert got.tolist() == [5.0, 5.0, 5.0] and trees[0].feature.tolist() == [-1] * 63


def test_pipeline_stage_saves_and_loads(spark, tmp_path):
    rows, labels = sample()
    df = spark.createDataFrame([(i, *r, y) for i, (r, y) in enumerate(zip(rows, labels))], "id long, a double, b double, c double, label double")
    model = models.fit(df, ["a", "b", "c"], models.gradient_boosting(3, 3, 0.3, key="id"))
    models.save_model(model, spark, str(tmp_path))
    back = models.load_model(spark, str(tmp_path))
    one, two = ([r["estimate"] for r in m.score(df).orderBy("id").collect()] for m in (model, back))
    assert one == two
    assert len(set(one)) > 4
    assert {r["feature"] for r in models.importances(back, spark).collect()} == {"a", "b", "c"}


def test_finished_seeds_are_not_fitted_again(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 5000.0 + 90 * m + rng.gauss(0, 300), float(m), rng.choice("abc"), rng.choice("xy")) for i, m in enumerate(rng.choices(range(40, 200), k=150))]
    df = spark.createDataFrame(rows, "id long, price double, m2 double, colonia string, municipio string")
    asked = []
    make = lambda seed: asked.append(seed) or models.linear()
    run = lambda seeds: {r["seed"]: r for r in models.multi_seed(df, seeds, "id", "price", make, ["m2", "colonia_enc"], str(tmp_path)).collect()}
    one = run([3])
    two = run([3, 5])
    assert asked == [3, 5] and two[3] == one[3] and set(two) == {3, 5}


def test_bin_numbers_are_read_where_they_lie():
    """No bytes object is made for a row: that took most of a level's time."""
    column = pa.array([bytes([i, i + 1, 255]) for i in range(6)], pa.binary())
    got = boosting._matrix(column[2:5], 3)
    assert got.tolist() == [[2, 3, 255], [3, 4, 255], [4, 5, 255]]
    assert np.shares_memory(got, np.frombuffer(column.buffers()[2], np.uint8))
    assert boosting._matrix(column[:0], 3).shape == (0, 3)


def test_one_job_grows_the_trees_of_a_job_for_each_level(spark, monkeypatch):
    rows, labels = sample(missing=0.2)
    s = Settings(trees=7, depth=3, step=0.3)
    got = []
    for tasks in (0, 1, 3):
        monkeypatch.setattr(boosting, "tasks_together", lambda *_: tasks)
        predictions, trees, gains = fitted(spark, rows, labels, s)
        got.append((predictions.tolist(), [t.pack() for t in trees], gains.tolist()))
    assert got[0] == got[1] == got[2] and sum(max(t["feature"]) >= 0 for t in got[0][1]) == 7


def test_trees_of_few_rows_take_one_job(spark):
    """500 trees were 2,500 jobs."""
    rows, labels = sample()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("trees", "trees")
    try:
        fitted(spark, rows, labels, Settings(trees=30, depth=4))
        assert len(tracker.getJobIdsForGroup("trees")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_in_parts_and_files_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(3)
    n, width = 500, 3
    bins = rng.integers(0, 9, (n, width)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.1] = boosting.MISSING
    raw = pa.array([r.tobytes() for r in bins], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 2**62, n)), pa.array(rng.normal(size=n)), raw, pa.array(np.zeros(n))], ["key", "label", "bins", "pred"])
    cuts, s, got = [np.arange(1.0, 9)] * width, Settings(trees=3, depth=3), []
    for part, block, kept in ((1 << 20, 1 << 15, 8), (64, 10, 2)):
        for name, value in (("PART", part), ("BLOCK", block), ("IN_MEMORY", kept)):
            monkeypatch.setattr(boosting, name, value)
        rows, trees = boosting._Rows((batch.slice(i, 50) for i in range(0, n, 50)), cuts, 1e-6, s), []
        for t in range(s.trees):
            rows.start(t)
            trees.append(boosting._grow(rows.sums, cuts, 1e-6, s, t, np.zeros(width)))
            rows.finish(trees[-1])
        got.append(([t.pack() for t in trees], np.concatenate([p[2] for p in rows.parts]).tolist(), len(rows.parts)))
    assert got[0][:2] == got[1][:2] and (got[0][2], got[1][2]) == (1, 5)


class Asked(Exception):
    """Trees and depth a query asks for."""


@pytest.mark.parametrize("name", ["k13_price_model", "k15_cross_validation", "k18_feature_ablation", "k19_encoding_leakage", "k20_target_transforms", "k21_multi_seed"])
def test_registered_models_grow_all_trees(spark, sf_dir, monkeypatch, name):
    def boosting(max_iter=500, depth=5, **_):
        raise Asked(max_iter, depth)

    monkeypatch.setattr(models, "gradient_boosting", boosting)
    with pytest.raises(Asked) as got:
        QUERIES[name](spark, sf_dir)
    assert got.value.args == (500, 5)


def test_compared_models_grow_all_trees(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "gradient_boosting", lambda max_iter=500, depth=5, **_: asked.append((max_iter, depth)) or models.linear())
    monkeypatch.setattr(models, "random_forest", lambda trees=300, depth=8, **_: asked.append((trees, depth)) or models.linear())
    assert QUERIES["k16_compare_models"](spark, sf_dir).count() == 3
    assert asked == [(300, 8), (500, 5)]
