"""Queries that fit models. Tree ensembles differ between engines, so these have no SQL twin; the
unit tests compare the boosted trees with brute force. Boosted trees are the library's default, 500; ``k12_random_forest`` has fewer trees."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import half_up
from valora.operators import encode, models, sampling, segment, select
from valora.operators.gram import linear_folds
from valora.plans import jobs
from valora.plans.registry import Context, query, rnd, sql_unit
from valora.session import scratch_path

TREES = 10
# --- fixed values: the seeds of the repeated fits ---
SEEDS = [42, 7, 123, 2024, 31415]
FEATURES = [*models.NUMERIC, *models.FLAGS, "colonia_enc", "municipio_enc"]


def window(c: Context) -> DataFrame:
    cols = ["listing_id", "price", "colonia", "municipio", "m2", "recamaras", "banos", "property_type", "lujo", "amueblado", "nuevo", "views", "lat", "lon"]
    return select.price_window(c.stored("listing", *cols))


def prepared(c: Context, mode: str = "oof", transform: str = "log1p", lam: float = 0.0) -> DataFrame:
    rows = window(c).withColumn("split", sampling.split2("listing_id", 42))
    return models.prepare(rows, "listing_id", "price", transform, lam, mode=mode, train=F.col("split") == "train")


def boosted(seed: int = 42) -> Estimator:
    return models.gradient_boosting(seed=seed, key="listing_id")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[half_up(c, 4).alias(c) for c in df.columns if c in ("mae", "rmse", "r2")], *[c for c in df.columns if c == "n"])


@query("k11_linear_regression")
def _(c: Context) -> DataFrame:
    rows = prepared(c)
    n = rows.filter("split = 'train'").count()
    return rounded(models.compare_models(
        rows, FEATURES, {"ols": models.linear, "ridge": lambda: models.linear(1.0, n)}, transform="log1p"), "model")


@query(
    "k11_simple_regression",
    f"SELECT {rnd('regr_slope(price, m2)', 4)} AS slope, {rnd('regr_intercept(price, m2)', 3)} AS intercept FROM listing WHERE m2 IS NOT NULL",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.filter("m2 IS NOT NULL").withColumn("label", F.col("price"))
    lm = models.fit(rows, ["m2"], models.linear()).pipeline.stages[-1]
    return c.spark.createDataFrame([(float(lm.coefficients[0]), float(lm.intercept))], "slope DOUBLE, intercept DOUBLE").select(
        half_up("slope", 4).alias("slope"), half_up("intercept", 3).alias("intercept"))


@query("k12_random_forest")
def _(c: Context) -> DataFrame:
    rows = prepared(c)
    model = models.fit(rows, FEATURES, models.random_forest(TREES, 6), "log1p", train=F.col("split") == "train")
    return models.importances(model, c.spark)


@query("k13_price_model")
def _(c: Context) -> DataFrame:
    model, rows = models.fit_price_model(window(c), features=FEATURES)
    return rounded(models.test_metrics(model, rows))


@query("k15_cross_validation")
def _(c: Context) -> DataFrame:
    folds = models.cross_validate(prepared(c), FEATURES, boosted, 5, transform="log1p")
    got = models.cv_summary(folds)
    return got.select(*[half_up(x, 4).alias(x) for x in ("r2_mean", "r2_sd", "mae_mean", "mae_sd")], "folds")


_POINTS = (
    f"(SELECT m2::DOUBLE AS x1, recamaras::DOUBLE AS x2, ln(1 + price) AS y, floor({sql_unit('listing_id', 42)} * 5)::INT AS fold "
    "FROM listing WHERE m2 IS NOT NULL AND recamaras IS NOT NULL AND price IS NOT NULL)"
)


@query(
    "k15_linear_folds",
    f"""SELECT m.fold, features, alpha, count(*) AS n, {rnd("1 - sum((y - a0 - b1 * x1 - b2 * x2) ** 2) / (var_pop(y) * count(*))")} AS r2,
        {rnd("sqrt(avg((y - a0 - b1 * x1 - b2 * x2) ** 2))")} AS rmse
    FROM (SELECT *, y0 - b1 * m1 - b2 * m2 AS a0 FROM (
            SELECT *, CASE features WHEN 'area' THEN c1y / (c11 + alpha) ELSE (c1y * (c22 + alpha) - c2y * c12) / ((c11 + alpha) * (c22 + alpha) - c12 * c12) END AS b1,
                CASE features WHEN 'area' THEN 0.0 ELSE (c2y * (c11 + alpha) - c1y * c12) / ((c11 + alpha) * (c22 + alpha) - c12 * c12) END AS b2
            FROM (SELECT k.fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS y0, var_pop(x1) * count(*) AS c11, var_pop(x2) * count(*) AS c22,
                    covar_pop(x1, x2) * count(*) AS c12, covar_pop(x1, y) * count(*) AS c1y, covar_pop(x2, y) * count(*) AS c2y
                FROM (SELECT DISTINCT fold FROM {_POINTS}) k JOIN {_POINTS} p ON p.fold <> k.fold GROUP BY k.fold)
            CROSS JOIN (SELECT unnest(['area', 'area_rooms']) AS features) CROSS JOIN (SELECT unnest([0.0, 100.0])::DOUBLE AS alpha))) m
    JOIN {_POINTS} p ON p.fold = m.fold GROUP BY m.fold, features, alpha""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.stored("listing", "listing_id", "price", "m2", "recamaras").withColumn("label", F.log1p("price"))
    rows = rows.withColumn("fold", sampling.kfold("listing_id", 5, 42))
    got = linear_folds(rows, {"area": ["m2"], "area_rooms": ["m2", "recamaras"]}, "label", alphas=(0.0, 100.0))
    return got.select("fold", "features", "alpha", "n", half_up("r2", 4).alias("r2"), half_up("rmse", 4).alias("rmse"))


@query("k16_compare_models")
def _(c: Context) -> DataFrame:
    makers = {
        "linear": models.linear,
        "forest": models.random_forest,
        "boosting": boosted,
    }
    return rounded(models.compare_models(prepared(c, "train"), FEATURES, makers, transform="log1p"), "model")


@query("k18_feature_ablation")
def _(c: Context) -> DataFrame:
    sets = {"with": FEATURES, "without": [f for f in FEATURES if f not in ("views", "lujo")]}
    return rounded(models.ablate(prepared(c), sets, boosted, transform="log1p"), "features")


@query("k19_encoding_leakage")
def _(c: Context) -> DataFrame:
    out = None
    for mode in ("all", "train"):
        m = models.compare_models(prepared(c, mode), FEATURES, {mode: boosted}, transform="log1p")
        out = m if out is None else out.unionByName(m)
    return rounded(out, "model")


@query("k20_target_transforms")
def _(c: Context) -> DataFrame:
    out = None
    for name, lam in (("log1p", 0.0), ("boxcox", encode.fit_boxcox(window(c).select("price"), "price"))):
        m = models.compare_models(prepared(c, "train", name, lam), FEATURES, {name: boosted}, transform=name, lam=lam)
        out = m if out is None else out.unionByName(m)
    return rounded(out, "model")


@query("k21_multi_seed")
def _(c: Context) -> DataFrame:
    got = models.multi_seed(window(c), SEEDS, "listing_id", "price", boosted, FEATURES, scratch_path(c.spark, "seeds"))
    return got.select("seed", *[half_up(x, 4).alias(x) for x in ("mae_pct", "acc_15", "acc_20", "lam")], "n")


@query("k22_score_listings")
def _(c: Context) -> DataFrame:
    rows = prepared(c, "train")
    model = models.fit(rows, FEATURES, models.linear(), "log1p", train=F.col("split") == "train")
    got = segment.valuation_flags(model.score(rows))
    return got.select("listing_id", half_up("estimate", 2).alias("estimate"), half_up("diff_pct").alias("diff_pct"), "over", "under")


@query("k23_importances")
def _(c: Context) -> DataFrame:
    model = models.fit(prepared(c), FEATURES, boosted(), "log1p", train=F.col("split") == "train")
    return models.importances(model, c.spark)


_CLUSTER = ["price", "lujo", "nuevo", "recamaras"]


@query("k24_kmeans")
def _(c: Context) -> DataFrame:
    rows, _cost = models.cluster(select.complete_cases(c.listing, _CLUSTER), _CLUSTER, 4)
    profile = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in _CLUSTER])
    tags = segment.cluster_tags(profile, c.listing, "price", ["lujo", "nuevo"])
    return tags.select("cluster", "n", half_up("price", 0).alias("price"), "tags")


@query("k24_elbow")
def _(c: Context) -> DataFrame:
    return models.elbow(select.complete_cases(c.listing, _CLUSTER), _CLUSTER, list(range(2, 11)))


@query("k25_principal_components")
def _(c: Context) -> DataFrame:
    rows = select.complete_cases(c.listing.select("listing_id", *_CLUSTER), _CLUSTER)
    return models.principal_components(rows, _CLUSTER).select("listing_id", half_up("pc1", 6).alias("pc1"), half_up("pc2", 6).alias("pc2"))


@query(
    "a18_model_round_trip",
    "SELECT count(*) AS n, 0.0::DOUBLE AS max_diff FROM listing WHERE price BETWEEN 4500 AND (SELECT quantile_cont(price, 0.99) FROM listing)",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = prepared(c, "train")
    model = models.fit(rows, FEATURES, models.linear(), "log1p", train=F.col("split") == "train")
    path = scratch_path(c.spark, "model")
    models.save_model(model, c.spark, path)
    back = models.load_model(c.spark, path)
    a = model.score(rows).select("listing_id", F.col("estimate").alias("a"))
    b = back.score(rows).select("listing_id", F.col("estimate").alias("b"))
    return a.join(b, "listing_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"))


@query("k22_question_valuation")
def _(c: Context) -> DataFrame:
    """Question to estimate to comparables to prompt, for every advert taken as a question."""
    from valora.plans.valuation import value_questions

    rows = prepared(c, "train")
    model = models.fit(rows, ["m2", "recamaras", "banos", "lujo", "amueblado", "nuevo", "colonia_enc"], models.linear(), "log1p",
                       train=F.col("split") == "train")
    encoder = encode.target_encoder(rows.filter("split = 'train'"), "colonia", "label")
    questions = c.ad.select(F.col("listing_id").alias("qid"), "text")
    pool = c.listing.withColumn("split", sampling.split2("listing_id", 42)).filter("split = 'train'").withColumnRenamed("listing_id", "id")
    got = value_questions(jobs.parse_questions(questions), model, encoder, pool)
    return got.select("qid", half_up("estimate", 2).alias("estimate"), F.length("prompt").alias("prompt_chars"))


