"""Exact quantiles whose cost per task does not grow with the size of a group.

The built-in exact percentile keeps every distinct value of a group in one task. Here one pass
takes a mergeable sketch per group (bounded memory) that brackets each wanted quantile; a second
pass counts the rows between the brackets as single numbers and keeps apart only the values inside
them, a fixed small share of the group. Both passes combine on the map side. The wanted ranks are
then read off the counts, so the answer is exact; a rank that fell outside its bracket (the sketch
guarantees it does not) fails the job instead of giving a wrong number. Where even the values
inside the brackets are too many for one task, their running counts are taken bin by bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valora.functions.numeric import col as as_col
from valora.session import materialize

ACCURACY = 10_000
WINDOW_ROWS = 1_000_000  # most bracket values one task may order by itself


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: dict[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with one column per named probability (linear interpolation, NULLs skipped)
    and ``n`` non-NULL values. With no keys the result is one row."""
    keys = list(keys)
    rows = df.select(*keys, as_col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    margin = 4.0 / accuracy
    cuts = [x for p in sorted(set(probs.values())) for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = materialize(
        rows.groupBy(*keys).agg(
            F.percentile_approx("__v", F.array(*[F.lit(c) for c in cuts]), F.lit(accuracy)).alias("__b"),
            F.count(F.lit(1)).alias("__rows"),
        ),
        "sketch",
    )
    biggest = sketch.agg(F.max("__rows")).first()[0] or 0
    if keys:
        renamed = sketch.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__b")
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        placed = rows.join(renamed, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    else:
        placed = rows.withColumn("__b", sketch.select("__b").scalar())
    inside = F.lit(False)
    for i in range(0, len(cuts), 2):
        inside = inside | F.col("__v").between(F.get("__b", F.lit(i)), F.get("__b", F.lit(i + 1)))
    below = F.size(F.filter("__b", lambda b: b < F.col("__v")))
    cells = (
        placed.select(
            *keys, "__v", F.when(inside, F.col("__v")).alias("__keep"), F.when(~inside, below).alias("__gap")
        )
        .groupBy(*keys, "__keep", "__gap")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    )
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    if biggest * 2 * margin * len(probs) <= WINDOW_ROWS:
        # The values inside the brackets of the largest group fit one small window.
        cells = cells.withColumn(
            "__end", F.sum("__n").over(part.orderBy("__lo").rowsBetween(W.unboundedPreceding, W.currentRow))
        ).withColumn("__total", F.sum("__n").over(part))
    else:
        from valora.operators.ordering import running_before

        cells = materialize(cells, "bracket-cells")
        totals = cells.groupBy(*keys).agg(F.sum("__n").alias("__total"))
        cells = running_before(cells, keys, [F.col("__lo")], F.col("__n"), "__before")
        cells = cells.withColumn("__end", F.col("__before") + F.col("__n"))
        if keys:
            cells = attach(cells, totals, keys)
        else:
            cells = cells.withColumn("__total", totals.select("__total").scalar())
    start = F.col("__end") - F.col("__n")

    def at(index: Column) -> Column:
        here = (start <= index) & (index < F.col("__end"))
        exact = (
            F.when(F.col("__lo") == F.col("__hi"), F.col("__lo"))
            .when(index == start, F.col("__lo"))
            .when(index == F.col("__end") - 1, F.col("__hi"))
            .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        )
        return F.max(F.when(here, exact))

    aggs = []
    for i, p in enumerate(probs.values()):
        h = F.lit(float(p)) * (F.col("__total") - 1)
        aggs += [
            at(F.floor(h)).alias(f"__a{i}"),
            at(F.ceil(h)).alias(f"__c{i}"),
            F.max(h - F.floor(h)).alias(f"__f{i}"),
        ]
    out = cells.groupBy(*keys).agg(F.max("__total").alias("n"), *aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"__a{i}") + (F.col(f"__c{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}")).alias(name)
            for i, name in enumerate(probs)
        ],
        "n",
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def scalar_quantile(df: DataFrame, value: str | Column, p: float) -> Column:
    """The quantile of the whole column, as a scalar subquery."""
    return exact_quantiles(df, [], value, {"q": p}).select("q").scalar()


def scalar(df: DataFrame, expr: Column) -> Column:
    return df.agg(expr.alias("s")).scalar()


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], store: bool = True) -> DataFrame:
    """Left-join per-group statistics to the rows.

    The statistics are stored first, so the join knows their true size: broadcast when small,
    otherwise a shuffled join whose hot keys adaptive execution splits.
    """
    small = materialize(stats, "stats") if store else stats
    renamed = small.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys]
    )
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(renamed, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])
