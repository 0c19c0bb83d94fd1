"""Feature engineering: target encodings, imputation, transforms fitted on the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import col
from valora.operators.quantile import attach, exact_quantiles
from valora.session import materialize


def _smooth(mean: Column, n: Column, base: Column, k: float) -> Column:
    return (mean * n + base * F.lit(float(k))) / (n + F.lit(float(k)))


def target_encoder(df: DataFrame, cat: str, y: str | Column, k: float = 10.0) -> DataFrame:
    """(key, n, enc, global_mean) with enc = (mean*n + global_mean*k) / (n + k)."""
    rows = df.select(F.col(cat).alias("key"), col(y).alias("y"))
    base = rows.agg(F.avg("y").alias("g")).scalar()
    stats = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("y").alias("n"), F.avg("y").alias("m"))
    return stats.select(
        "key", "n", _smooth(F.col("m"), F.col("n"), base, k).alias("enc"), base.alias("global_mean")
    )


def map_default(df: DataFrame, encoder: DataFrame, key: str, out: str, default: Column | None = None) -> DataFrame:
    """Left lookup of an encoder; unseen and NULL keys get the global mean."""
    enc = materialize(encoder.select(F.col("key").alias(key), F.col("enc").alias(out), "global_mean"), "encoder")
    fallback = enc.agg(F.max("global_mean")).scalar() if default is None else default
    got = attach(df, enc.drop("global_mean"), [key], store=False)
    return got.withColumn(out, F.coalesce(F.col(out), fallback))


def target_encode(
    df: DataFrame, cats: Sequence[str], y: str | Column, k: float = 10.0, fit_on: Column | None = None
) -> DataFrame:
    """Add ``<cat>_enc``; ``fit_on`` restricts fitting to the training rows."""
    train = df if fit_on is None else df.filter(fit_on)
    for cat in cats:
        df = map_default(df, target_encoder(train, cat, y, k), cat, f"{cat}_enc")
    return df


def fold_encoders(df: DataFrame, cat: str, y: str | Column, fold: str, k: float = 10.0) -> DataFrame:
    """(key, fold, n, enc): the encoder that each fold's model uses, fitted without that fold.

    Every fold's statistics are the totals minus the fold's own, so the data is read once however
    many folds there are.
    """
    cells = materialize(
        df.select(F.col(cat).alias("key"), F.col(fold).alias("fold"), col(y).alias("y"))
        .groupBy("key", "fold")
        .agg(F.sum("y").alias("s"), F.count("y").alias("n")),
        "folds",
    )
    total = cells.groupBy("key").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    per_fold = cells.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    everything = cells.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n")).alias("a")).scalar()
    # Folds are few; each key gets one row per fold from the list of folds.
    folds = per_fold.agg(
        F.collect_list(F.struct("fold", "fs", "fn")).alias("f")
    ).scalar()
    grid = total.withColumn("f", F.explode(folds)).select("key", "ts", "tn", "f.*")
    own = cells.select(F.col("key").alias("key2"), F.col("fold").alias("fold2"), F.col("s").alias("os"), F.col("n").alias("on"))
    got = grid.join(own, F.col("key").eqNullSafe(F.col("key2")) & (F.col("fold") == F.col("fold2")), "left")
    base = (everything["s"] - F.col("fs")) / (everything["n"] - F.col("fn"))
    n = F.col("tn") - F.coalesce(F.col("on"), F.lit(0))
    rest = F.col("ts") - F.coalesce(F.col("os"), F.lit(0.0))
    enc = F.when(n > 0, _smooth(rest / n, n, base, k)).otherwise(base)
    return got.select("key", "fold", n.alias("n"), enc.alias("enc"), base.alias("global_mean"))


def target_encode_oof(df: DataFrame, cats: Sequence[str], y: str | Column, fold: str, k: float = 10.0) -> DataFrame:
    """Out-of-fold column: each row is encoded by the encoder fitted without its own fold."""
    for cat in cats:
        enc = fold_encoders(df, cat, y, fold, k).select(
            F.col("key").alias(cat), F.col("fold").alias(fold), F.col("enc").alias(f"{cat}_enc")
        )
        df = attach(df, enc, [cat, fold])
    return df


def median_encode(df: DataFrame, cat: str, y: str, out: str) -> DataFrame:
    """Median target per category, the overall median where the category is NULL or empty."""
    overall = exact_quantiles(df, [], y, {"q": 0.5}).select("q").scalar()
    med = exact_quantiles(df.filter(F.col(cat).isNotNull()), [cat], y, {out: 0.5}).drop("n")
    return attach(df, med, [cat]).withColumn(out, F.coalesce(F.col(out), overall))


def fitted_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of several columns as driver scalars (one per column)."""
    spans = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("s")).select("s.*")
    return {r["name"]: r["m"] for r in exact_quantiles(spans, ["name"], "v", {"m": 0.5}).collect()}


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    medians = fitted_medians(df if fit_on is None else df.filter(fit_on), cols)
    return df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def fill_defaults(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    return df.select(*[
        F.coalesce(F.col(c), F.lit(spec[c])).alias(c) if c in spec else F.col(c) for c in df.columns
    ])


def label_encode(df: DataFrame, cat: str, out: str) -> DataFrame:
    """Alphabetical 0-based code. The distinct names are ranked in bins, never in one task."""
    from valora.operators.ordering import numbered

    names = df.select(cat).distinct().filter(F.col(cat).isNotNull())
    codes = numbered(names, [], [F.col(cat)], out).withColumn(out, (F.col(out) - 1).cast("int"))
    return attach(df, codes, [cat])


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd; a constant column becomes 0."""
    stats = df.agg(F.struct(*[
        x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))
    ]).alias("s"))
    row = stats.select("s").scalar()
    scaled = {
        c: (F.col(c) - row[f"{c}_m"]) / F.when(row[f"{c}_s"] == 0, 1.0).otherwise(row[f"{c}_s"]) for c in cols
    }
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def repair_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted features in order, missing ones as 0."""
    return df.select(*keep, *[
        F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in df.columns else F.lit(0.0).alias(f)
        for f in features
    ])


def boxcox_likelihood(df: DataFrame, value: str, lambdas: Sequence[float]) -> DataFrame:
    """Log-likelihood of every candidate exponent, all in one aggregation."""
    x = F.col(value)
    logx = F.log(x)
    aggs = [F.sum(logx).alias("slog"), F.count(x).alias("n")]
    for i, lam in enumerate(lambdas):
        y = logx if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)
        aggs.append(F.var_pop(y).alias(f"v{i}"))
    row = df.filter(x > 0).agg(*aggs)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(float(lam)).alias("lam"), F.col(f"v{i}").alias("v")) for i, lam in enumerate(lambdas)
    ]))
    return row.select("slog", "n", pairs.alias("p")).select(
        F.col("p.lam").alias("lam"),
        ((F.col("p.lam") - 1) * F.col("slog") - F.col("n") / 2 * F.log("p.v")).alias("llf"),
    )


def fit_boxcox(df: DataFrame, value: str, lo: float = -2.0, hi: float = 2.0, rounds: int = 6, grid: int = 9) -> float:
    """Maximum-likelihood exponent: a grid per round, then a narrower bracket around its best point."""
    rows = df.select(value)
    for _ in range(rounds):
        step = (hi - lo) / (grid - 1)
        table = boxcox_likelihood(rows, value, [lo + step * i for i in range(grid)])
        best = table.agg(F.max_by("lam", "llf")).first()[0]
        lo, hi = best - step, best + step
    return (lo + hi) / 2


def geo_features(lat: str = "lat", lon: str = "lon") -> dict[str, Column]:
    from valora.functions import fixed
    from valora.functions.numeric import haversine

    center = [F.lit(x) for x in fixed.CITY_CENTER]
    return {
        "dist_center_km": haversine(lat, lon, *center),
        "dist_avenue_km": F.abs(F.col(lat) - fixed.MAIN_AVENUE_LAT) * fixed.KM_PER_DEGREE,
    }


def relative_floor(floor: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(floor) / F.col(total))


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile (Acklam's rational approximation, relative error below 1.2e-9)."""
    # --- fixed values: published coefficients of the approximation ---
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(coefs: Sequence[float], x: Column) -> Column:
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + F.lit(k)
        return out

    low = 0.02425
    q = F.sqrt(-2 * F.log(p))
    r = (p - 0.5) * (p - 0.5)
    u = F.sqrt(-2 * F.log(1 - p))
    tail = lambda x: poly(c, x) / (poly(d, x) * x + 1)
    return F.when(p < low, tail(q)).when(p > 1 - low, -tail(u)).otherwise(
        (p - 0.5) * poly(a, r) / (poly(b, r) * r + 1)
    )


def filliben(i: Column, n: Column) -> Column:
    """Median rank positions of ordered values."""
    top = F.pow(F.lit(0.5), F.lit(1.0) / n)
    return F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))


