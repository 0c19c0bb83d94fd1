"""Aggregations over listings: group medians, histograms, box statistics, coverage, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import col
from valora.operators.quantile import attach, exact_quantiles


def top_groups(df: DataFrame, key: str, value: str, min_n: int, n: int) -> DataFrame:
    """Groups with enough rows, highest median first."""
    stats = exact_quantiles(df, [key], value, {"median": 0.5})
    return stats.filter(F.col("n") >= min_n).orderBy(F.desc("median"), key).limit(n)


def with_without(df: DataFrame, flags: Mapping[str, Column], value: str) -> DataFrame:
    """Mean of the value with and without each flag, one pass for all flags."""
    aggs = []
    for i, flag in enumerate(flags.values()):
        aggs += [F.avg(F.when(flag, col(value))).alias(f"w{i}"), F.avg(F.when(~flag, col(value))).alias(f"o{i}")]
    return long_form(df.agg(*aggs), {name: {"with_mean": f"w{i}", "without_mean": f"o{i}"} for i, name in enumerate(flags)}, "keyword")


def long_form(row: DataFrame, names: Mapping[str, Mapping[str, str]], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Turn one wide row (per key) into one row per name."""
    items = F.array(*[
        F.struct(F.lit(name).alias(label), *[F.col(src).alias(dst) for dst, src in cols.items()])
        for name, cols in names.items()
    ])
    return row.select(*keys, F.explode(items).alias("__x")).select(*keys, "__x.*")


def flag_rates(df: DataFrame, flags: Sequence[str], populations: Mapping[str, Column]) -> DataFrame:
    """Percentage of rows with flag = 1 in each population."""
    aggs, names = [], {}
    for i, (pop, cond) in enumerate(populations.items()):
        for j, flag in enumerate(flags):
            on = F.coalesce(F.col(flag) == 1, F.lit(False)).cast("int")
            aggs.append((F.avg(F.when(cond, on)) * 100).alias(f"r{i}_{j}"))
            names[f"{pop}|{flag}"] = {"pct": f"r{i}_{j}"}
    out = long_form(df.agg(*aggs), names, "name")
    parts = F.split("name", r"\|")
    return out.select(parts[0].alias("population"), parts[1].alias("flag"), "pct")


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of all column pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}"))
    out = long_form(df.agg(*aggs), {f"{a}|{b}": {"r": f"c{i}"} for i, (a, b) in enumerate(pairs)}, "name")
    parts = F.split("name", r"\|")
    return out.select(parts[0].alias("a"), parts[1].alias("b"), "r")


def histogram(df: DataFrame, value: str | Column, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed."""
    rows = df.select(col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    span = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    width = (span["hi"] - span["lo"]) / F.lit(float(bins))
    index = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - span["lo"]) / width), F.lit(bins - 1)))
    return rows.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whisker ends (last value within 1.5 IQR) and number of outliers per group."""
    q = exact_quantiles(df, [key], value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    rows = attach(df.select(key, value).filter(F.col(value).isNotNull()), q, [key])
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return rows.groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("n", "q1", "med", "q3")],
        F.min(F.when(inside, F.col(value))).alias("low"),
        F.max(F.when(inside, F.col(value))).alias("high"),
        F.count_if(~inside).alias("outliers"),
    )


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [F.count("*").alias("__n"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)]]
    row = df.agg(*aggs)
    out = long_form(row, {c: {"present": f"n_{i}", "total": "__n"} for i, c in enumerate(cols)}, "name")
    return out.select("name", "present", (F.col("present") / F.col("total") * 100).alias("pct"))


def signal_counts(df: DataFrame, text: str | Column, patterns: Mapping[str, str]) -> DataFrame:
    """Number of rows that match each pattern."""
    rows = df.select(F.lower(F.coalesce(col(text), F.lit(""))).alias("t"))
    row = rows.agg(*[F.count_if(F.col("t").rlike(p)).alias(f"n{i}") for i, p in enumerate(patterns.values())])
    return long_form(row, {name: {"n": f"n{i}"} for i, name in enumerate(patterns)}, "signal")


def word_counts(df: DataFrame, tokens: Column, stop: Sequence[str], pre_k: int | None, k: int) -> DataFrame:
    """Most frequent tokens; with ``pre_k`` the stop words are removed from the top ``pre_k`` only."""
    counts = df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if pre_k:
        counts = counts.orderBy(F.desc("n"), "word").limit(pre_k)
    return counts.filter(~F.col("word").isin(list(stop))).orderBy(F.desc("n"), "word").limit(k)


def segment_table(df: DataFrame, segment: str, price: str, flags: Sequence[str], segments: Sequence[str]) -> DataFrame:
    """Metrics as rows, segments as columns."""
    med = exact_quantiles(df, [segment], price, {"median_price": 0.5}).drop("n")
    stats = df.groupBy(segment).agg(
        F.count("*").cast("double").alias("n"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        *[(F.avg(f) * 100).alias(f"pct_{f}") for f in flags],
    )
    wide = stats.join(med, segment)
    metrics = [c for c in wide.columns if c != segment]
    tall = wide.unpivot([segment], metrics, "metric", "value")
    return tall.groupBy("metric").pivot(segment, list(segments)).agg(F.first("value"))


def pct_change(current: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    ref = reference.select(key, F.col(value).alias("reference"))
    return current.join(ref, key).withColumn("change_pct", (F.col(value) - F.col("reference")) / F.col("reference") * 100)


def rare_bucket(df: DataFrame, column: str, min_n: int, other: str, out: str) -> DataFrame:
    """Categories with fewer rows than ``min_n`` become ``other``."""
    frequent = df.groupBy(column).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_n).filter(F.col(column).isNotNull())
    got = attach(df, frequent, [column])
    return got.withColumn(out, F.when(F.col("__n").isNotNull(), F.col(column)).otherwise(other)).drop("__n")


def winsorize_by(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Cap at the group's quantile, keep all rows."""
    caps = exact_quantiles(df, [key], value, {"__cap": q}).drop("n")
    got = attach(df, caps, [key])
    return got.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.col(value), F.col("__cap")))).drop("__cap")


def relative_to_group(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Group median and the value relative to it."""
    med = exact_quantiles(df, [key], value, {"group_median": 0.5}).drop("n")
    return attach(df, med, [key]).withColumn(out, F.col(value) / F.col("group_median"))
