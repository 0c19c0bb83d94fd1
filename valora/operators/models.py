"""Price models on Spark ML: features, fitting, cross-validation, comparison, scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.numeric import half_up, target_transform
from valora.operators import encode, evaluate, sampling
from valora.operators.boosting import HistogramBooster, Settings
from valora.operators.evaluate import normal_cdf
from valora.operators.ordering import running_before
from valora.operators.quantile import exact_quantiles
from valora.session import materialize

NUMERIC = ["m2", "recamaras", "banos", "lat", "lon", "views"]
FLAGS = ["lujo", "amueblado", "nuevo"]
CATEGORIES = ["colonia", "municipio"]


@dataclass(frozen=True)
class PriceModel:
    """A fitted regression with everything needed to score: medians, encoders, transform."""

    pipeline: PipelineModel
    features: list[str]
    transform: str
    lam: float
    medians: dict[str, float] = field(default_factory=dict)

    def inverse(self, c: Column) -> Column:
        return target_transform(self.transform, self.lam)[1](c)

    def score(self, df: DataFrame, out: str = "estimate") -> DataFrame:
        filled = df.select(*[
            F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0))).alias(c) if c in self.medians else F.col(c)
            for c in df.columns
        ])
        got = self.pipeline.transform(filled)
        return got.withColumn(out, self.inverse(F.col("prediction"))).drop("features", "prediction")


def save_model(model: PriceModel, spark: SparkSession, path: str) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame(
        [(model.features, model.transform, model.lam, model.medians)],
        "features ARRAY<STRING>, transform STRING, lam DOUBLE, medians MAP<STRING, DOUBLE>",
    ).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> PriceModel:
    schema = "features ARRAY<STRING>, transform STRING, lam DOUBLE, medians MAP<STRING, DOUBLE>"
    meta = spark.read.schema(schema).json(f"{path}/meta").first()
    return PriceModel(PipelineModel.load(f"{path}/pipeline"), list(meta["features"]), meta["transform"], meta["lam"], dict(meta["medians"]))


def gradient_boosting(max_iter: int = 500, depth: int = 5, step: float = 0.05, seed: int = 42, key: str | None = None) -> Estimator:
    """Boosted trees with leaf penalties (L1 0.1, L2 1.0); 80 % of rows and features in each tree."""
    return HistogramBooster(Settings(trees=max_iter, depth=depth, step=step, seed=seed), key)


def random_forest(trees: int = 300, depth: int = 8, seed: int = 42) -> Estimator:
    return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)


def linear(alpha: float = 0.0, n: int = 1) -> Estimator:
    """Least squares, or ridge with penalty ``alpha`` on the sum of squared errors of ``n`` rows."""
    return LinearRegression(
        featuresCol="features", labelCol="label", elasticNetParam=0.0, regParam=alpha / max(n, 1), standardization=False,
        solver="normal",
    )


def prepare(df: DataFrame, key: str, price: str, transform: str, lam: float, folds: int = 5, seed: int = 42,
            mode: str = "oof", cats: Sequence[str] = tuple(CATEGORIES), train: Column | None = None) -> DataFrame:
    """Transformed label, fold and category encodings; stored, because fitting reads it many times.

    ``mode`` is ``oof`` (out of fold), ``train`` (fitted on the training rows) or ``all`` (leaky).
    """
    forward, _ = target_transform(transform, lam)
    rows = df.withColumn("label", forward(F.col(price))).withColumn("fold", sampling.kfold(key, folds, seed))
    if mode == "oof":
        rows = encode.target_encode_oof(rows, cats, "label", "fold")
    else:
        rows = encode.target_encode(rows, cats, "label", fit_on=train if mode == "train" else None)
    return materialize(rows, "features")


def fit(df: DataFrame, features: Sequence[str], estimator: Estimator, transform: str = "none", lam: float = 0.0,
        train: Column | None = None) -> PriceModel:
    """Impute with training medians, assemble and fit."""
    rows = df if train is None else df.filter(train)
    medians = encode.fitted_medians(rows, features)
    filled = rows.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))).alias(c) if c in features else F.col(c)
        for c in rows.columns
    ])
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])
    full = {f: medians.get(f, 0.0) for f in features}
    return PriceModel(pipeline.fit(filled), list(features), transform, lam, full)


def fit_price_model(df: DataFrame, key: str = "listing_id", price: str = "price", max_iter: int = 500, seed: int = 42,
                    features: Sequence[str] | None = None) -> tuple[PriceModel, DataFrame]:
    """The flagship model: window already applied, Box-Cox target, out-of-fold encodings, boosted trees.

    Returns the model and the prepared rows (with ``split``).
    """
    lam = encode.fit_boxcox(df, price)
    rows = prepare(df.withColumn("split", sampling.split2(key, seed)), key, price, "boxcox", lam, seed=seed)
    names = list(features or [*NUMERIC, *FLAGS, *[f"{c}_enc" for c in CATEGORIES]])
    model = fit(rows, names, gradient_boosting(max_iter, seed=seed, key=key), "boxcox", lam, F.col("split") == "train")
    return model, rows


def test_metrics(model: PriceModel, rows: DataFrame, price: str = "price") -> DataFrame:
    scored = model.score(rows.filter("split = 'test'"))
    return evaluate.regression_metrics(scored, price, "estimate")


def cross_validate(df: DataFrame, features: Sequence[str], make: Callable[[], Estimator], folds: int, price: str = "price",
                   transform: str = "none", lam: float = 0.0, cats: Sequence[str] = tuple(CATEGORIES), fold: str = "fold") -> DataFrame:
    """R² and MAE of each fold's test rows on the original scale.

    In run f every row, training and test, uses the encoders fitted without fold f; the few fold
    models are fitted one after another, each a distributed job.
    """
    encoders = {c: materialize(encode.fold_encoders(df, c, "label", fold), "fold-encoders") for c in cats}
    out = None
    for f in range(folds):
        rows = df.drop(*[f"{c}_enc" for c in cats])
        for c in cats:
            enc = encoders[c].filter(F.col("fold") == f)
            rows = encode.map_default(rows, enc, c, f"{c}_enc")
        model = fit(rows, features, make(), transform, lam, F.col(fold) != f)
        m = evaluate.regression_metrics(model.score(rows.filter(F.col(fold) == f)), price, "estimate").withColumn("fold", F.lit(f))
        out = m if out is None else out.unionByName(m)
    return out


def cv_summary(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return folds.groupBy(*by).agg(
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_sd"), F.avg("mae").alias("mae_mean"),
        F.stddev_pop("mae").alias("mae_sd"), F.count("*").alias("folds"),
    )


def compare_models(rows: DataFrame, features: Sequence[str], makers: dict[str, Callable[[], Estimator]], price: str = "price",
                   transform: str = "none", lam: float = 0.0) -> DataFrame:
    """Test metrics of several learners on the same split and features."""
    out = None
    for name, make in makers.items():
        model = fit(rows, features, make(), transform, lam, F.col("split") == "train")
        m = test_metrics(model, rows, price).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def ablate(rows: DataFrame, sets: dict[str, Sequence[str]], make: Callable[[], Estimator], price: str = "price",
           transform: str = "none", lam: float = 0.0) -> DataFrame:
    """Test metrics of the same learner with different feature sets."""
    out = None
    for name, features in sets.items():
        m = test_metrics(fit(rows, features, make(), transform, lam, F.col("split") == "train"), rows, price).withColumn("features", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def importances(model: PriceModel, spark: SparkSession) -> DataFrame:
    """Feature importances with names, highest first (one row per model input)."""
    values = model.pipeline.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(model.features, values, strict=True)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")


def baseline_predict(df: DataFrame, cat: str, price: str, split: str) -> DataFrame:
    """Global median, and zone median with the global one as fallback, both from training rows."""
    train = df.filter(F.col(split) == "train")
    overall = exact_quantiles(train, [], price, {"q": 0.5}).select("q").scalar()
    zones = exact_quantiles(train, [cat], price, {"zone": 0.5}).drop("n")
    got = encode.attach(df, zones, [cat])
    preds = F.array(
        F.struct(F.lit("global").alias("baseline"), overall.alias("pred")),
        F.struct(F.lit("zone").alias("baseline"), F.coalesce(F.col("zone"), overall).alias("pred")),
    )
    return got.withColumn("__p", F.explode(preds)).select(*df.columns, "__p.*")


def params_to_features(df: DataFrame, colonia_enc: DataFrame, prefix: str = "q_", fuzzy: bool = False) -> DataFrame:
    """Model inputs from parsed question parameters, defaults where the question is silent."""
    from valora.operators.joins import resolve_category

    d = fixed.FEATURE_DEFAULTS

    def num(name: str) -> Column:
        source = F.col(f"{prefix}{name}") if f"{prefix}{name}" in df.columns else F.lit(None)
        # Zero counts as not given.
        return F.coalesce(F.nullif(source.cast("double"), F.lit(0.0)), F.lit(d[name])).alias(name)

    words = {
        "alberca": "pill_pool", "gimnasio": "pill_gym", "elevador": "pill_elevator", "terraza": "pill_terrace",
        "rooftop": "pill_rooftop", "jardín": "pill_garden", "seguridad": "pill_security",
    }
    pills = [F.array_contains(F.col(f"{prefix}amenidades"), w).cast("double").alias(p) for w, p in words.items()]
    keep = [c for c in df.columns if not c.startswith(prefix)]
    base = df.select(
        *keep, F.col(f"{prefix}colonia").alias("colonia"),
        *[num(n) for n in ("m2", "recamaras", "banos", "estacionamientos")],
        *[F.lit(d[n]).alias(n) for n in ("lat", "lon", "userviews", "days_listed")],
        *[F.col(f"{prefix}{n}").cast("double").alias(n) for n in ("lujo", "amueblado", "nuevo")],
        *pills,
    )
    total = F.lit(0.0)
    for p in words.values():
        total = total + F.col(p)
    base = base.withColumn("amenidades_count", total)
    if fuzzy:
        return resolve_category(base, colonia_enc, "colonia")
    return encode.map_default(base, colonia_enc, "colonia", "colonia_enc")


def multi_seed(df: DataFrame, seeds: Sequence[int], key: str, price: str, make: Callable[[int], Estimator], features: Sequence[str],
               store: str) -> DataFrame:
    """Accuracy of each seed, for which split, transform, encoders and model are learned anew.

    A seed's row is written to the shared folder ``store`` when it is done; seeds found there are not fitted again.
    """
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for seed in seeds:
        mark = path(f"{store}/{seed}/_SUCCESS")
        if mark.getFileSystem(conf).exists(mark):
            continue
        split = df.withColumn("split", sampling.split3(key, seed))
        lam = encode.fit_boxcox(split.filter("split = 'train'"), price)
        rows = prepare(split, key, price, "boxcox", lam, seed=seed, mode="train", train=F.col("split") == "train")
        model = fit(rows, features, make(seed), "boxcox", lam, F.col("split") == "train")
        scored = model.score(rows.filter("split = 'test'")).withColumn("err", evaluate.error_pct("estimate", price))
        got = evaluate.accuracy(scored.withColumn("seed", F.lit(seed)), ["seed"]).withColumn("lam", F.lit(lam))
        got.coalesce(1).write.mode("overwrite").parquet(f"{store}/{seed}")
    return spark.read.parquet(*[f"{store}/{seed}" for seed in seeds])


def cluster(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """Standardised k-means: rows with their cluster, and the within-cluster cost."""
    vectors = _vectors(df, cols)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("features", *[f"__s_{c}" for c in cols]), float(model.summary.trainingCost)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    copies = df.select("*", *[F.col(c).cast("double").alias(f"__s_{c}") for c in cols])
    scaled = encode.standardise(copies, [f"__s_{c}" for c in cols])
    return materialize(VectorAssembler(inputCols=[f"__s_{c}" for c in cols], outputCol="features").transform(scaled), "vectors")


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    """Within-cluster cost for each k (one small row per k)."""
    vectors = _vectors(df, cols)
    rows = [(k, float(KMeans(k=k, seed=seed, featuresCol="features").fit(vectors).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k INT, cost DOUBLE")


def principal_components(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """First components of the standardised (hence centred) columns."""
    from pyspark.ml.functions import vector_to_array

    vectors = _vectors(df, cols)
    got = PCA(k=k, inputCol="features", outputCol="__pc").fit(vectors).transform(vectors)
    got = got.withColumn("__pc", vector_to_array("__pc"))
    return got.select(*df.columns, *[F.col("__pc")[i].alias(f"pc{i + 1}") for i in range(k)])


CELLS, FAR = 4096, 8.0  # cells of a standard deviation in which residuals are counted, and where the last ones begin


def residual_shape(df: DataFrame, res: str, by: str = "model") -> DataFrame:
    """Mean, sd, skewness, kurtosis and the distance of the residuals from a normal distribution.

    The distance is the largest gap between the normal distribution and the running share of the rows,
    just before and at every distinct residual (null where all residuals are equal). Residuals are counted in
    cells first; the counts and ends of a cell bound its gaps, and only residuals of cells that can hold the largest are
    put in order.
    """
    base = df.groupBy(by).agg(
        F.count(res).alias("n"), F.avg(res).alias("mean"), F.stddev_pop(res).alias("sd"), F.skewness(res).alias("skew"), F.kurtosis(res).alias("kurt")
    )
    stats = materialize(base, "shape")
    shape = stats.where("sd > 0").select(by, F.col("n").alias("all"), "mean", "sd")
    rows = encode.attach(df.select(by, F.col(res).alias("r")).where("r IS NOT NULL"), shape, [by], store=False).where("sd > 0")
    p = lambda r: normal_cdf((F.col(r) - F.col("mean")) / F.col("sd"))
    z = (F.col("r") - F.col("mean")) / F.col("sd")
    rows = rows.withColumn("cell", F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), z)) * CELLS).cast("int"))
    cells = materialize(rows.groupBy(by, "cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")), "cells")
    cells = encode.attach(running_before(cells, [by], [F.col("cell")], F.col("n")), shape, [by], store=False)
    start, end = F.col("before") / F.col("all"), (F.col("before") + F.col("n")) / F.col("all")
    cells = cells.select(by, "cell", F.col("before").alias("earlier"), F.greatest(p("lo") - start, end - p("hi")).alias("least"), F.greatest(p("hi") - start, end - p("lo")).alias("most"))
    cells = materialize(cells, "cells")
    least = cells.groupBy(by).agg(F.max("least").alias("bar"))
    wanted = materialize(encode.attach(cells, least, [by]).where(F.col("most") >= F.col("bar") - 1e-12).select(by, "cell", "earlier"), "wanted")
    counts = rows.join(wanted.select(F.col(by).alias("__by"), F.col("cell").alias("__cell")), F.col(by).eqNullSafe(F.col("__by")) & (F.col("cell") == F.col("__cell")), "left_semi")
    counts = materialize(counts.groupBy(by, "cell", "r").agg(F.count("*").alias("k")), "residuals")
    ranked = encode.attach(running_before(counts, [by, "cell"], [F.col("r")], F.col("k")), wanted, [by, "cell"], store=False)
    ranked = encode.attach(ranked, shape, [by], store=False).withColumn("before", F.col("before") + F.col("earlier"))
    gap = F.greatest(p("r") - F.col("before") / F.col("all"), (F.col("before") + F.col("k")) / F.col("all") - p("r"))
    dist = ranked.withColumn("gap", gap).groupBy(by).agg(F.max("gap").alias("ks"))
    return encode.attach(stats, dist, [by], store=False).select(by, "n", *[half_up(c, 4).alias(c) for c in ("mean", "sd", "skew", "kurt", "ks")])
