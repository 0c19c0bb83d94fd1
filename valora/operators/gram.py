"""Cross-validated least squares and ridge from one pass of sums of products.

The sums of all products of two columns are taken by fold in one grouped aggregation. What a model is fitted on is the
total less its fold, a set of features is a part of the matrix, and the errors on the fold follow from the fold's own
sums: any number of folds, feature sets and penalties costs no further pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "fold INT, features STRING, alpha DOUBLE, n BIGINT, r2 DOUBLE, rmse DOUBLE, intercept DOUBLE, coefficients MAP<STRING, DOUBLE>"


def linear_folds(
    df: DataFrame, sets: Mapping[str, Sequence[str]], label: str, fold: str = "fold", alphas: Sequence[float] = (0.0,),
) -> DataFrame:
    """One row per fold, feature set and penalty: R² and RMSE on the fold's rows of the model fitted on all others.

    ``alphas`` penalise the squared coefficients of the columns as they are, not the intercept. Rows with a null or
    non-finite feature (of any set), label or a null fold are left out, repeated rows count as often as they occur.
    Among dependent features the solution of smallest norm on the standardised columns is taken. R² is null where
    the labels of a fold are equal, all measures where no other fold has rows. An empty table gives no rows. The
    driver sees one row of sums per fold.
    """
    names = list(dict.fromkeys(f for features in sets.values() for f in features))
    usable = F.col(fold).isNotNull()
    columns = []
    for i, c in enumerate([*names, label]):
        x = F.col(c).cast("double")
        usable &= F.abs(x) < F.lit(float("inf"))
        columns.append(x.alias(f"x{i}"))
    rows = df.where(usable).select(F.col(fold).cast("int").alias("fold"), *columns)
    size = len(columns)

    # Centred and scaled columns first: sums of products of raw ones cancel.
    means = rows.agg(*[F.avg(f"x{i}") for i in range(size)], *[F.stddev_pop(f"x{i}") for i in range(size)]).first()
    if means[0] is None:
        return df.sparkSession.createDataFrame([], RESULT)
    mean = np.array(means[:size])
    scale = np.array([s or 1.0 for s in means[size:]])
    z = rows.select("fold", *[((F.col(f"x{i}") - float(mean[i])) / float(scale[i])).alias(f"x{i}") for i in range(size)])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = z.groupBy("fold").agg(F.count("*"), *[F.sum(f"x{i}") for i in range(size)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs])
    found = {r[0]: _moments(r[1:], size, pairs) for r in sums.collect()}
    total = reduce(lambda a, b: [x + y for x, y in zip(a, b)], found.values())

    out = []
    for f, own in sorted(found.items()):
        train = [a - b for a, b in zip(total, own)]
        for name, features in sets.items():
            at = [names.index(c) for c in features]
            for alpha in alphas:
                if train[0] == 0:
                    out.append((f, name, float(alpha), int(own[0]), None, None, None, {}))
                    continue
                b, a = _solve(train, at, alpha / scale[at] ** 2)
                r2, mse = _errors(own, at, b, a)
                y = scale[-1]
                raw = b * y / scale[at]
                intercept = float(mean[-1] + a * y - raw @ mean[at])
                out.append((f, name, float(alpha), int(own[0]), r2, float(np.sqrt(mse) * y), intercept, dict(zip(features, map(float, raw)))))
    return df.sparkSession.createDataFrame(out, RESULT)


def _moments(row, size: int, pairs) -> list:
    """Count, sums and matrix of sums of products; the label comes last."""
    products = np.zeros((size, size))
    for (i, j), value in zip(pairs, row[1 + size:]):
        products[i, j] = products[j, i] = value
    return [row[0], np.array(row[1:1 + size]), products]


def _solve(moments: list, at: list[int], penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the standardised columns."""
    n, sums, products = moments
    centred = products - np.outer(sums, sums) / n
    b = np.linalg.lstsq(centred[np.ix_(at, at)] + np.diag(penalty), centred[at, -1], rcond=1e-12)[0]
    return b, float((sums[-1] - b @ sums[at]) / n)


def _errors(moments: list, at: list[int], b: np.ndarray, a: float) -> tuple[float | None, float]:
    """R² and mean squared error from the moments of the rows that are predicted."""
    n, sums, products = moments
    part, v = [*at, -1], np.append(-b, 1.0)
    sse = max(0.0, float(v @ products[np.ix_(part, part)] @ v - 2 * a * (v @ sums[part]) + n * a * a))
    spread = float(products[-1, -1] - sums[-1] ** 2 / n)
    return (1 - sse / spread if spread > 1e-12 * n else None), sse / n
