"""Evaluation of predictions: error measures, coverage views, paired tests.

Every measure is one aggregation; probabilities of test statistics are computed on the few
result rows (``tails``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from valora.functions.numeric import col, half_up
from valora.functions.rules import stars
from valora.operators.aggregate import long_form
from valora.operators.ordering import running_before


def answered(pred: str | Column) -> Column:
    """A missing or zero price is no answer."""
    return F.coalesce(col(pred) != 0, F.lit(False))


def error_pct(pred: str | Column, real: str | Column, penalty: float | None = None) -> Column:
    """Percent error; an unanswered question gets NULL, or the penalty."""
    err = F.when(answered(pred) & (col(real) != 0), F.abs(col(pred) - col(real)) / col(real) * 100)
    return err if penalty is None else F.when(col(real) != 0, F.coalesce(err, F.lit(penalty)))


def _within(err: Column, limit: float) -> Column:
    return F.avg(F.when(err.isNotNull(), (err <= limit).cast("int"))) * 100


def accuracy(df: DataFrame, by: Sequence[str], err: str = "err") -> DataFrame:
    e = F.col(err)
    return df.groupBy(*by).agg(
        F.avg(e).alias("mae_pct"), _within(e, 15).alias("acc_15"), _within(e, 20).alias("acc_20"), F.count(e).alias("n")
    )


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = F.col(y) - F.col(yhat)
    return rows.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.count("*").alias("n"),
    )


def three_views(df: DataFrame, in_all: Column, pred: str, real: str, model: str = "model", penalty: float = 100.0) -> DataFrame:
    """Answered only, answered by every model, and unanswered penalised, per model."""
    e, p = error_pct(pred, real), error_pct(pred, real, penalty)
    rows = df.select(model, e.alias("e"), F.when(in_all, e).alias("i"), p.alias("p"))
    stats, names = [], {}
    for view, c in (("original", "e"), ("intersection", "i"), ("penalised", "p")):
        stats += [F.avg(c).alias(f"{c}_m"), _within(F.col(c), 15).alias(f"{c}_15"), _within(F.col(c), 20).alias(f"{c}_20"), F.count(c).alias(f"{c}_n")]
        names[view] = {"mae_pct": f"{c}_m", "within_15": f"{c}_15", "within_20": f"{c}_20", "n": f"{c}_n"}
    return long_form(rows.groupBy(model).agg(*stats), names, "view", [model])


def non_response(df: DataFrame, pred: str, by: Sequence[str], denominator: str = "total") -> DataFrame:
    """Share of questions without a price, of all questions or of the answered ones."""
    miss, all_rows = F.count_if(~answered(pred)), F.count("*")
    base = all_rows if denominator == "total" else all_rows - miss
    return df.groupBy(*by).agg(miss.alias("missing"), (miss / base * 100).alias("rate"))


def anchor_respect(df: DataFrame, answer: str, anchor: str, by: Sequence[str] = (), limit: float = 20.0) -> DataFrame:
    has = answered(answer) & answered(anchor)
    dev = F.when(has, F.abs(F.col(answer) - F.col(anchor)) / F.col(anchor) * 100)
    return df.groupBy(*by).agg(
        (F.count_if(answered(answer)) / F.count("*") * 100).alias("parseable_pct"),
        F.count(dev).alias("with_anchor"),
        (F.count_if(dev <= limit) / F.count(dev) * 100).alias("respected_pct"),
    )


def error_by_bin(df: DataFrame, bin_col: str, pred: str, real: str, err: str) -> DataFrame:
    from valora.operators.quantile import exact_quantiles

    rows = df.filter(F.col(bin_col).isNotNull() & F.col(err).isNotNull())
    base = rows.groupBy(bin_col).agg(F.avg(err).alias("mean_err"), F.count("*").alias("n"))
    mp = exact_quantiles(rows, [bin_col], pred, {"median_pred": 0.5}).drop("n")
    mr = exact_quantiles(rows, [bin_col], real, {"median_real": 0.5}).drop("n")
    return base.join(mp, bin_col).join(mr, bin_col)


def mcnemar(pairs: DataFrame, a: str, b: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Continuity-corrected McNemar test of "within the threshold" for two aligned error columns."""
    ok_a, ok_b = F.col(a) <= threshold, F.col(b) <= threshold
    cells = pairs.groupBy(*by).agg(F.count_if(~ok_a & ok_b).alias("n01"), F.count_if(ok_a & ~ok_b).alias("n10"))
    d = F.abs(F.col("n01") - F.col("n10")) - 1
    n = F.col("n01") + F.col("n10")
    return cells.withColumn("chi2", F.when(n > 0, d * d / n).otherwise(0.0))


def wilcoxon(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank statistic with zeros dropped and the tie-corrected normal approximation.

    Equal differences are counted first; the ranks come from running totals over the distinct
    absolute differences, so no task sees all rows.
    """
    d = F.col(a) - F.col(b)
    counts = (
        pairs.select(*by, F.abs(d).alias("v"), (d > 0).alias("up")).filter("v > 0")
        .groupBy(*by, "v").agg(F.count("*").alias("t"), F.count_if("up").alias("plus"))
    )
    ranked = running_before(counts, by, [F.col("v")], F.col("t"))
    rank = F.col("before") + (F.col("t") + 1) / 2
    s = ranked.groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum(rank * F.col("plus")).alias("w_plus"),
        F.sum(rank * (F.col("t") - F.col("plus"))).alias("w_minus"),
        F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
    )
    nd = F.col("n").cast("double")
    var = nd * (nd + 1) * (2 * nd + 1) / 24 - F.col("ties") / 48
    w = F.least("w_plus", "w_minus")
    return s.select(*by, "n", w.alias("w"), ((w - nd * (nd + 1) / 4) / F.sqrt(var)).alias("z"))


def average_ranks(df: DataFrame, value: str, keep: Sequence[str]) -> DataFrame:
    """Average rank of every row among all rows, ties sharing theirs."""
    from valora.operators.quantile import attach

    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("t")).filter("v IS NOT NULL")
    ranked = running_before(counts, [], [F.col("v")], F.col("t"))
    ranks = ranked.select(F.col("v").alias(value), (F.col("before") + (F.col("t") + 1) / 2).alias("rank"))
    return attach(df.select(*keep, value), ranks, [value])


def dm_test(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Diebold–Mariano as a one-sample t on |a| - |b|."""
    d = F.abs(F.col(a)) - F.abs(F.col(b))
    return pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).select(
        *by, "n", "mean", (F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t")
    )


def ttest_ind(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Pooled two-sample t between flag = 1 and flag = 0."""
    one, zero = F.when(F.col(flag) == 1, F.col(value)), F.when(F.col(flag) == 0, F.col(value))
    s = df.agg(
        F.count(one).alias("n1"), F.avg(one).alias("m1"), F.var_samp(one).alias("v1"),
        F.count(zero).alias("n0"), F.avg(zero).alias("m0"), F.var_samp(zero).alias("v0"),
    )
    df_ = F.col("n1") + F.col("n0") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / df_
    return s.select(
        (F.col("n1") + F.col("n0")).alias("n"),
        ((F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))).alias("t"),
    )


def ci_overlap(cis: DataFrame, name: str = "model") -> DataFrame:
    """Verdict for every pair of models whether their intervals overlap.

    ``cis`` has one row per model: the pairs are a generator over that short list.
    """
    others = cis.agg(F.collect_list(F.struct(name, "lo", "hi")).alias("o")).scalar()
    pairs = cis.withColumn("o", F.explode(others)).filter(F.col(name) < F.col(f"o.{name}"))
    return pairs.select(
        F.col(name).alias("a"), F.col(f"o.{name}").alias("b"),
        ((F.col("lo") <= F.col("o.hi")) & (F.col("o.lo") <= F.col("hi"))).alias("overlap"),
    )


def delta_table(metrics: DataFrame, key: str, value: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Measure of run ``a`` minus that of run ``b``."""
    pick = lambda m: F.max(F.when(F.col(key) == m, F.col(value)))
    return metrics.groupBy(*by).agg((pick(a) - pick(b)).alias("delta"))


def run_summary(metrics: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population sd over runs."""
    return metrics.groupBy(*by).agg(
        half_up(F.avg(value), 2).alias("mean"), half_up(F.stddev_pop(value), 2).alias("sd"), F.count("*").alias("runs")
    )


def order_preserved(metrics: DataFrame, run: str, key: str, value: str, a: str, b: str) -> DataFrame:
    """In how many runs ``a`` is at least ``b``."""
    pick = lambda m: F.max(F.when(F.col(key) == m, F.col(value)))
    wide = metrics.groupBy(run).agg(pick(a).alias("a"), pick(b).alias("b"))
    return wide.agg(F.count_if(F.col("a") >= F.col("b")).alias("preserved"), F.count("*").alias("runs"))


def threshold_accuracy(df: DataFrame, kind: str, answer: str, score: str, threshold: float = 0.33) -> DataFrame:
    """Accuracy by kind and overall; an empty answer counts as wrong overall only."""
    empty = F.trim(F.coalesce(F.col(answer), F.lit(""))) == ""
    ok = (F.col(score) > threshold).cast("int")
    rows = df.select(F.col(kind).alias("kind"), F.when(~empty, ok).alias("ok"), F.when(empty, 0).otherwise(ok).alias("all"))
    by = rows.groupBy("kind").agg((F.avg("ok") * 100).alias("accuracy"), F.count("ok").alias("n"))
    total = rows.agg((F.avg("all") * 100).alias("accuracy"), F.count("all").alias("n")).select(F.lit("TOTAL").alias("kind"), "accuracy", "n")
    return by.unionByName(total)


def audit_answers(df: DataFrame, text: str) -> DataFrame:
    """Rule checks of an answer: states a price, at most three sentences, no code."""
    from valora.functions.parse import extract_price

    sentences = F.size(F.filter(F.split(F.trim(text), r"[.!?]+(?:\s+|$)"), lambda s: F.trim(s) != ""))
    code = F.col(text).rlike(r"```|\bdef \w+\(|\bimport \w+|print\(")
    return df.withColumn("has_price", extract_price(text, "loose").isNotNull()).withColumn(
        "short", sentences <= 3).withColumn("no_code", ~code)


# ---- tail probabilities -------------------------------------------------------------------
def chi2_sf1(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def normal_sf2(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_sf2(t: float, dof: float) -> float:
    """Two-sided Student t tail by the continued fraction of the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float, rounds: int = 300) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d if abs(1.0 + num * d) > tiny else tiny)
            c = 1.0 + num / c
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


ERFC_END = 9.0  # beyond, erfc is below 1e-36


@cache
def _erfc_polynomial(degree: int = 24) -> list[float]:
    """Coefficients in u, from the highest down, of log(erfc(x) / t) + x² for t = 2 / (2 + x), u running over
    [-1, 1] as x does over [0, ``ERFC_END``]: interpolated at Chebyshev points."""
    low = 2 / (2 + ERFC_END)

    def value(u: float) -> float:
        t = low + (1 - low) * (u + 1) / 2
        x = 2 / t - 2
        return math.log(math.erfc(x) / t) + x * x

    fitted = np.polynomial.chebyshev.chebinterpolate(np.vectorize(value), degree)
    return np.polynomial.chebyshev.cheb2poly(fitted)[::-1].tolist()


def erfc_column(x: Column) -> Column:
    """Complementary error function of a column that is not negative, as one expression."""
    low = 2 / (2 + ERFC_END)

    def inside(t: Column) -> Column:
        u = (t - low) * (2 / (1 - low)) - 1
        total = F.lit(0.0)
        for c in _erfc_polynomial():
            total = total * u + c
        return t * F.exp(total - (2 / t - 2) * (2 / t - 2))

    return F.when(x > ERFC_END, 0.0).otherwise(F.transform(F.array(2 / (2 + x)), inside)[0])


def normal_cdf(z: Column) -> Column:
    """Normal distribution function, exact to about 1e-13, without a Python worker."""
    half = erfc_column(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z < 0, half).otherwise(1 - half)


@F.pandas_udf(DoubleType())
def tail_probability(kind: pd.Series, stat: pd.Series, dof: pd.Series) -> pd.Series:
    """p-value column for tables of many tests; ``kind`` is chi2, normal or t."""
    def one(k: str, s: float, d: float) -> float | None:
        if pd.isna(s):
            return None
        return {"chi2": lambda: chi2_sf1(s), "normal": lambda: normal_sf2(s), "t": lambda: t_sf2(s, d)}[k]()

    return pd.Series([one(k, s, d) for k, s, d in zip(kind, stat, dof, strict=True)], dtype="float64")


def with_p_value(df: DataFrame, kind: str, stat: str, dof: Column | None = None) -> DataFrame:
    d = F.lit(None).cast("double") if dof is None else dof.cast("double")
    got = df.withColumn("p", tail_probability(F.lit(kind), F.col(stat), d))
    return got.withColumn("sig", stars("p"))
