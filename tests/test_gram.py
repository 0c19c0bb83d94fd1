import numpy as np
import pytest

from valora.operators.gram import linear_folds

SETS = {"all": ["a", "b", "c"], "one": ["b"], "twice": ["a", "b", "a2"]}


def table(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, c double, a2 double, y double, fold int, n string")


def brute(rows, at, fold, alpha):
    train, test = (np.array([r[:5] for r in rows if (r[5] == fold) == own]) for own in (False, True))
    x, y = train[:, at], train[:, 4]
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.lstsq(np.vstack([xc, np.sqrt(alpha) * np.eye(len(at))]), np.append(yc, np.zeros(len(at))), rcond=1e-10)[0]
    err = test[:, 4] - (y.mean() + (test[:, at] - x.mean(0)) @ b)
    return 1 - (err @ err) / ((test[:, 4] - test[:, 4].mean()) ** 2).sum(), np.sqrt((err @ err) / len(test)), b


def some_rows(offset):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) * [1, 50, 0.01] + offset
    y = x @ [2.0, -0.1, 30.0] + rng.normal(size=200)
    return [(float(a), float(b), float(c), float(2 * a), float(v), int(f), "x") for (a, b, c), v, f in zip(x, y, rng.integers(0, 4, 200))]


@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_folds_sets_and_penalties_against_brute_force(spark, offset):
    rows = some_rows(offset)
    odd = [(None, 1.0, 1.0, 1.0, 1.0, 0, "x"), (float("nan"), 1.0, 1.0, 1.0, 1.0, 1, "x"), (1.0, float("-inf"), 1.0, 1.0, 1.0, 1, "x"),
           (1.0, 1.0, 1.0, 1.0, None, 2, "x"), (1.0, 1.0, 1.0, 1.0, 1.0, None, "x")]
    got = linear_folds(table(spark, rows + odd), SETS, "y", alphas=(0.0, 3.0)).collect()
    assert len(got) == 4 * 3 * 2
    for r in got:
        at = [["a", "b", "c", "a2"].index(c) for c in SETS[r.features]]
        r2, rmse, b = brute(rows, at, r.fold, r.alpha)
        assert r.n == sum(x[5] == r.fold for x in rows)
        assert r.r2 == pytest.approx(r2, abs=1e-6) and r.rmse == pytest.approx(rmse, rel=1e-5)
        if r.features != "twice":
            assert [r.coefficients[c] for c in SETS[r.features]] == pytest.approx(list(b), rel=1e-4, abs=1e-6)


def test_edges(spark):
    assert linear_folds(table(spark, []), SETS, "y").collect() == []
    one = linear_folds(table(spark, some_rows(0.0)[:1] * 3), SETS, "y").collect()
    assert [(r.n, r.r2, r.rmse, r.coefficients) for r in one] == [(3, None, None, {})] * 3
    same = [(1.0, float(i), 1.0, 2.0, 5.0, i % 2, "x") for i in range(6)]
    flat = linear_folds(table(spark, same), SETS, "y").collect()
    assert all(r.r2 is None and r.rmse == pytest.approx(0, abs=1e-9) for r in flat)
    rows = some_rows(0.0)
    once, twice = (linear_folds(table(spark, rows * k), {"one": ["b"]}, "y").orderBy("fold").collect() for k in (1, 2))
    assert [(2 * r.n, pytest.approx(r.r2)) for r in once] == [(r.n, r.r2) for r in twice]
