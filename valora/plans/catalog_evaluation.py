"""Queries for feature engineering that SQL can check, and for prediction evaluation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed, numeric, rules
from valora.functions.numeric import half_up
from valora.operators import encode, evaluate, joins, sampling, select
from valora.plans import jobs
from valora.plans.catalog_columns import _price_sql
from valora.plans.registry import Context, query, rnd, sql_unit
from valora.streaming import incremental

_LAMBDAS = [-1.0, -0.5, 0.0, 0.25, 0.358876, 0.5, 0.7, 1.0]


def _llf_sql(lam: float) -> str:
    y = "ln(price)" if lam == 0 else f"(pow(price, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    return f"SELECT {lam}::DOUBLE AS lam, {rnd(f'({lam}::DOUBLE - 1) * sum(ln(price)) - count(*) / 2.0 * ln(var_pop({y}))', 3)} AS llf FROM listing"


@query("k1_boxcox_likelihood", " UNION ALL ".join(_llf_sql(x) for x in _LAMBDAS), "listing")
def _(c: Context) -> DataFrame:
    return encode.boxcox_likelihood(c.listing, "price", _LAMBDAS).select("lam", half_up("llf", 3).alias("llf"))


@query("k1_fit_boxcox")
def _(c: Context) -> DataFrame:
    lam = encode.fit_boxcox(select.price_window(c.listing.select("price")), "price")
    return c.listing.agg(F.count("price").alias("n"), half_up(F.avg(numeric.boxcox("price", lam)), 3).alias("mean_bc")).withColumn("lam", F.lit(round(lam, 4)))


def _enc_sql(key: str, k: int, where: str = "true") -> str:
    g = f"(SELECT avg(price) FROM listing WHERE {where})"
    return f"SELECT {key} AS k, (avg(price) * count(*) + {g} * {k}) / (count(*) + {k}) AS enc FROM listing WHERE {where} GROUP BY 1"


@query(
    "k2_target_encode",
    f"""SELECT listing_id, {rnd('a.enc', 3)} AS colonia_enc, {rnd('b.enc', 3)} AS recamaras_enc FROM listing
        LEFT JOIN ({_enc_sql('colonia', 10)}) a ON a.k = colonia LEFT JOIN ({_enc_sql('CAST(recamaras AS VARCHAR)', 10)}) b ON b.k = CAST(recamaras AS VARCHAR)
        WHERE recamaras IS NOT NULL""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.select("listing_id", "colonia", F.col("recamaras").cast("string"), "price")
    got = encode.target_encode(rows, ["colonia", "recamaras"], "price").filter("recamaras IS NOT NULL")
    return got.select("listing_id", half_up("colonia_enc", 3).alias("colonia_enc"), half_up("recamaras_enc", 3).alias("recamaras_enc"))


@query(
    "k2_target_encode_building",
    f"SELECT listing_id, {rnd('coalesce(enc, (SELECT avg(price) FROM listing))', 3)} AS enc FROM listing LEFT JOIN ({_enc_sql('concat(colonia, banos)', 5, 'banos IS NOT NULL').replace('(SELECT avg(price) FROM listing WHERE banos IS NOT NULL)', '(SELECT avg(price) FROM listing)')}) ON k = concat(colonia, banos) AND banos IS NOT NULL",
    "listing",
)
def _(c: Context) -> DataFrame:
    # Buildings have few rows each, hence the weaker smoothing; a NULL building gets the overall mean.
    rows = c.listing.select("listing_id", F.concat("colonia", F.col("banos").cast("string")).alias("b"), "price")
    return encode.target_encode(rows, ["b"], "price", k=5).select("listing_id", half_up("b_enc", 3).alias("enc"))


_TRAIN = f"{sql_unit('listing_id', 42)} < 0.8"


@query(
    "k3_train_only_encoding",
    f"""SELECT listing_id, {rnd(f'coalesce(enc, (SELECT avg(price) FROM listing WHERE {_TRAIN}))', 3)} AS enc FROM listing LEFT JOIN ({_enc_sql('colonia', 10, _TRAIN)}) ON k = colonia""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.stored("listing", "listing_id", "colonia", "price").withColumn("split", sampling.split2("listing_id", 42))
    got = encode.target_encode(rows, ["colonia"], "price", fit_on=F.col("split") == "train")
    return got.select("listing_id", half_up("colonia_enc", 3).alias("enc"))


_FOLD = f"CAST(floor({sql_unit('listing_id', 42)} * 5) AS INT)"


@query(
    "k4_out_of_fold_encoding",
    f""", f AS (SELECT listing_id, colonia, price, {_FOLD} AS fold FROM listing), g AS (SELECT DISTINCT fold AS h FROM f),
        m AS (SELECT h, avg(price) AS gm FROM f JOIN g ON fold <> h GROUP BY h),
        e AS (SELECT colonia AS k, h, (avg(price) * count(*) + max(gm) * 10) / (count(*) + 10) AS enc FROM f JOIN m ON fold <> h GROUP BY 1, 2)
        SELECT listing_id, fold, {rnd('coalesce(enc, gm)', 3)} AS enc FROM f JOIN m ON fold = m.h LEFT JOIN e ON k = colonia AND e.h = fold""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.stored("listing", "listing_id", "colonia", "price").withColumn("fold", sampling.kfold("listing_id", 5, 42))
    got = encode.target_encode_oof(rows, ["colonia"], "price", "fold")
    return got.select("listing_id", "fold", half_up("colonia_enc", 3).alias("enc"))


@query(
    "k5_median_encode",
    f"""SELECT listing_id, {rnd('coalesce(m, (SELECT quantile_cont(price, 0.5) FROM listing))')} AS enc FROM listing
        LEFT JOIN (SELECT recamaras AS k, quantile_cont(price, 0.5) AS m FROM listing WHERE recamaras IS NOT NULL GROUP BY 1) ON k = recamaras""",
    "listing",
)
def _(c: Context) -> DataFrame:
    got = encode.median_encode(c.listing.select("listing_id", "recamaras", "price"), "recamaras", "price", "enc")
    return got.select("listing_id", half_up("enc").alias("enc"))


@query(
    "k6_impute_median",
    """SELECT listing_id, coalesce(m2, (SELECT quantile_cont(m2, 0.5) FROM listing)) AS m2,
       coalesce(CAST(recamaras AS DOUBLE), (SELECT quantile_cont(recamaras, 0.5) FROM listing)) AS recamaras FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return encode.impute_median(c.listing.select("listing_id", "m2", "recamaras"), ["m2", "recamaras"])


@query("k7_impute_zero", "SELECT listing_id, coalesce(m2, 0.0) AS m2, coalesce(banos, 0) AS banos FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return encode.fill_defaults(c.listing.select("listing_id", "m2", "banos"), {"m2": 0.0, "banos": 0})


@query("k8_label_encode", "SELECT listing_id, CAST(dense_rank() OVER (ORDER BY colonia) - 1 AS INT) AS code FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return encode.label_encode(c.listing.select("listing_id", "colonia"), "colonia", "code").select("listing_id", "code")


@query(
    "k9_standardise",
    f"""SELECT listing_id, {rnd('(price - (SELECT avg(price) FROM listing)) / (SELECT stddev_pop(price) FROM listing)', 6)} AS price,
        {rnd('(m2 - (SELECT avg(m2) FROM listing)) / (SELECT stddev_pop(m2) FROM listing)', 6)} AS m2 FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    got = encode.standardise(c.listing.select("listing_id", "price", "m2"), ["price", "m2"])
    return got.select("listing_id", half_up("price", 6).alias("price"), half_up("m2", 6).alias("m2"))


@query(
    "k10_question_features",
    f"""SELECT listing_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)(\\d+)\\s*m[²2]', 1), '') AS DOUBLE), 85.0) AS m2,
        coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)(\\d+)\\s*rec[áa]mara', 1), '') AS DOUBLE), 2.0) AS recamaras,
        CASE WHEN contains(lower(text), 'alberca') THEN 1.0 ELSE 0.0 END::DOUBLE AS pill_pool,
        ((contains(lower(text), 'alberca'))::INT + (contains(lower(text), 'gimnasio'))::INT + (contains(lower(text), 'elevador'))::INT
          + (contains(lower(text), 'terraza'))::INT + (contains(lower(text), 'rooftop'))::INT + (contains(lower(text), 'jardín'))::INT
          + (contains(lower(text), 'seguridad'))::INT)::DOUBLE AS amenidades_count,
        {rnd('coalesce(enc, (SELECT avg(price) FROM listing))', 3)} AS colonia_enc
        FROM ad LEFT JOIN ({_enc_sql('colonia', 10)}) ON k = trim(nullif(regexp_extract(text, '{fixed.Q_ZONE}', 1), ''))""",
    "ad listing",
)
def _(c: Context) -> DataFrame:
    from valora.operators.models import params_to_features

    enc = encode.target_encoder(c.listing, "colonia", "price")
    asked = jobs.parse_questions(c.ad.select("listing_id", "text"))
    got = params_to_features(asked, enc)
    return got.select("listing_id", "m2", "recamaras", "pill_pool", "amenidades_count", half_up("colonia_enc", 3).alias("colonia_enc"))


@query(
    "k14_regression_metrics",
    f"""SELECT model, {rnd('avg(abs(precio_real - precio_predicho))', 3)} AS mae, {rnd('sqrt(avg(pow(precio_real - precio_predicho, 2)))', 3)} AS rmse,
        {rnd('1 - sum(pow(precio_real - precio_predicho, 2)) / (var_pop(precio_real) * count(*))', 6)} AS r2, count(*) AS n
        FROM prediction WHERE precio_predicho IS NOT NULL GROUP BY model""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    m = evaluate.regression_metrics(c.prediction, "precio_real", "precio_predicho", ["model"])
    return m.select("model", half_up("mae", 3).alias("mae"), half_up("rmse", 3).alias("rmse"), half_up("r2", 6).alias("r2"), "n")


@query(
    "k17_naive_baselines",
    f""", s AS (SELECT listing_id, colonia, price, {_TRAIN} AS tr FROM listing), g AS (SELECT quantile_cont(price, 0.5) AS gm FROM s WHERE tr),
        z AS (SELECT colonia AS k, quantile_cont(price, 0.5) AS zm FROM s WHERE tr GROUP BY 1),
        p AS (SELECT price, gm, coalesce(zm, gm) AS zm FROM s CROSS JOIN g LEFT JOIN z ON k = colonia WHERE NOT tr)
        SELECT 'global' AS baseline, {rnd('avg(abs(price - gm))', 3)} AS mae, {rnd('1 - sum(pow(price - gm, 2)) / (var_pop(price) * count(*))', 6)} AS r2 FROM p
        UNION ALL SELECT 'zone', {rnd('avg(abs(price - zm))', 3)}, {rnd('1 - sum(pow(price - zm, 2)) / (var_pop(price) * count(*))', 6)} FROM p""",
    "listing",
)
def _(c: Context) -> DataFrame:
    from valora.operators.models import baseline_predict

    rows = c.stored("listing", "listing_id", "colonia", "price").withColumn("split", sampling.split2("listing_id", 42))
    preds = baseline_predict(rows, "colonia", "price", "split").filter("split = 'test'")
    m = evaluate.regression_metrics(preds, "price", "pred", ["baseline"])
    return m.select("baseline", half_up("mae", 3).alias("mae"), half_up("r2", 6).alias("r2"))


@query(
    "k26_repair_columns",
    "SELECT listing_id, coalesce(m2, 0.0)::DOUBLE AS m2, CAST(0 AS DOUBLE) AS pill_gym, price FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    return encode.repair_columns(c.listing, ["m2", "pill_gym", "price"], keep=["listing_id"])


# ---- evaluation ---------------------------------------------------------------------------
_E = "CASE WHEN precio_predicho <> 0 AND precio_real <> 0 THEN abs(precio_predicho - precio_real) / precio_real * 100 END"


@query("m1_error_pct", f"SELECT id, model, {rnd(_E)} AS err, {rnd(f'coalesce({_E}, 100)')} AS penalised FROM prediction", "prediction")
def _(c: Context) -> DataFrame:
    e = evaluate.error_pct
    return c.prediction.select("id", "model", half_up(e("precio_predicho", "precio_real")).alias("err"),
                               half_up(e("precio_predicho", "precio_real", 100.0)).alias("penalised"))


def _acc_sql(by: str) -> str:
    return f"""SELECT {by}, {rnd('avg(e)')} AS mae_pct, {rnd('avg((e <= 15)::INT) * 100')} AS acc_15, {rnd('avg((e <= 20)::INT) * 100')} AS acc_20, count(e) AS n
        FROM (SELECT *, {_E} AS e FROM prediction) GROUP BY {by}"""


def _acc(c: Context, by: list[str]) -> DataFrame:
    rows = c.prediction.withColumn("err", evaluate.error_pct("precio_predicho", "precio_real"))
    got = evaluate.accuracy(rows, by)
    return got.select(*by, *[half_up(x).alias(x) for x in ("mae_pct", "acc_15", "acc_20")], "n")


@query("m2_accuracy", _acc_sql("model"), "prediction")
def _(c: Context) -> DataFrame:
    return _acc(c, ["model"])


@query(
    "m3_three_views",
    f""", k AS (SELECT id AS kid FROM prediction WHERE precio_predicho IS NOT NULL GROUP BY id HAVING count(DISTINCT model) = 3),
        x AS (SELECT model, {_E} AS o, CASE WHEN kid IS NOT NULL THEN {_E} END AS i, coalesce({_E}, 100) AS p FROM prediction LEFT JOIN k ON kid = id)
        """ + " UNION ALL ".join(
        f"SELECT model, '{v}' AS view, {rnd(f'avg({x})')} AS mae_pct, {rnd(f'avg(({x} <= 15)::INT) * 100')} AS within_15, {rnd(f'avg(({x} <= 20)::INT) * 100')} AS within_20, count({x}) AS n FROM x GROUP BY model"
        for v, x in (("original", "o"), ("intersection", "i"), ("penalised", "p"))),
    "prediction",
)
def _(c: Context) -> DataFrame:
    ids = joins.answered_by_all(c.prediction, ["a", "b", "c"], "precio_predicho").withColumn("in_all", F.lit(True))
    rows = c.prediction.join(ids, "id", "left")
    got = evaluate.three_views(rows, F.coalesce("in_all", F.lit(False)), "precio_predicho", "precio_real")
    return got.select("model", "view", *[half_up(x).alias(x) for x in ("mae_pct", "within_15", "within_20")], "n")


@query(
    "m4_non_response",
    f"""SELECT model, count(*) FILTER (WHERE precio_predicho IS NULL) AS missing, {rnd('count(*) FILTER (WHERE precio_predicho IS NULL) * 100.0 / count(*)')} AS of_total,
        {rnd('count(*) FILTER (WHERE precio_predicho IS NULL) * 100.0 / count(precio_predicho)')} AS of_answered FROM prediction GROUP BY model""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    total = evaluate.non_response(c.prediction, "precio_predicho", ["model"])
    ans = evaluate.non_response(c.prediction, "precio_predicho", ["model"], "answered")
    return total.select("model", "missing", half_up("rate").alias("of_total")).join(ans.select("model", half_up("rate").alias("of_answered")), "model")


@query("m5_metrics_by_split", _acc_sql("split"), "prediction")
def _(c: Context) -> DataFrame:
    return _acc(c, ["split"])


@query("m6_mae_currency", f"SELECT model, {rnd('avg(abs(precio_predicho - precio_real))', 3)} AS mae FROM prediction GROUP BY model", "prediction")
def _(c: Context) -> DataFrame:
    return c.prediction.groupBy("model").agg(half_up(F.avg(F.abs(F.col("precio_predicho") - F.col("precio_real"))), 3).alias("mae"))


@query(
    "m7_anchor_respect",
    f"""SELECT model, {rnd('count(precio_predicho) * 100.0 / count(*)')} AS parseable_pct, count(precio_predicho) AS with_anchor,
        {rnd('avg((abs(precio_predicho - a) / a * 100 <= 20)::INT) * 100')} AS respected_pct FROM (SELECT *, precio_real * 1.1 AS a FROM prediction) GROUP BY model""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    got = evaluate.anchor_respect(c.prediction.withColumn("anchor", F.col("precio_real") * 1.1), "precio_predicho", "anchor", ["model"])
    return got.select("model", half_up("parseable_pct").alias("parseable_pct"), "with_anchor", half_up("respected_pct").alias("respected_pct"))


_PAIRS = f""", e AS (SELECT id, model, {_E} AS e FROM prediction), p AS (SELECT a.id, a.model AS m1, b.model AS m2, a.e AS a, b.e AS b
    FROM e a JOIN e b ON a.id = b.id AND a.model < b.model WHERE a.e IS NOT NULL AND b.e IS NOT NULL)"""


def error_pairs(c: Context) -> DataFrame:
    """Aligned errors of every pair of models, named by m1 and m2."""
    scored = c.prediction.withColumn("err", evaluate.error_pct("precio_predicho", "precio_real"))
    parts = [joins.align(scored, m1, m2, "err").withColumns({"m1": F.lit(m1), "m2": F.lit(m2)}) for m1, m2 in combinations("abc", 2)]
    return reduce(DataFrame.unionByName, parts)


@query(
    "m8_mcnemar",
    _PAIRS + f""" SELECT m1, m2, within, n01, n10, {rnd('pow(abs(n01 - n10) - 1, 2) / CAST(n01 + n10 AS DOUBLE)', 6)} AS chi2
        FROM (SELECT m1, m2, within, count(*) FILTER (WHERE a > within AND b <= within) AS n01, count(*) FILTER (WHERE a <= within AND b > within) AS n10
          FROM p, (VALUES (15), (20)) w(within) GROUP BY ALL)""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    pairs, out = error_pairs(c), ["m1", "m2", "within", "n01", "n10", half_up("chi2", 6).alias("chi2")]
    tests = [evaluate.mcnemar(pairs, "a", "b", w, ["m1", "m2"]).withColumn("within", F.lit(int(w))).select(*out) for w in (15.0, 20.0)]
    return reduce(DataFrame.unionByName, tests)


@query(
    "m9_wilcoxon",
    _PAIRS + f""", d AS (SELECT m1, m2, abs(a - b) AS v, a - b > 0 AS up FROM p WHERE a <> b),
        r AS (SELECT m1, m2, v, up, rank() OVER (PARTITION BY m1, m2 ORDER BY v) + (count(*) OVER (PARTITION BY m1, m2, v) - 1) / 2.0 AS rk FROM d),
        t AS (SELECT m1, m2, sum(pow(n, 3) - n) AS ties FROM (SELECT m1, m2, count(*) AS n FROM d GROUP BY m1, m2, v) GROUP BY m1, m2),
        s AS (SELECT m1, m2, count(*)::DOUBLE AS n, coalesce(sum(rk) FILTER (WHERE up), 0) AS wp, coalesce(sum(rk) FILTER (WHERE NOT up), 0) AS wm FROM r GROUP BY m1, m2)
        SELECT m1, m2, CAST(n AS BIGINT) AS n, least(wp, wm)::DOUBLE AS w, {rnd('(least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)', 6)} AS z FROM s JOIN t USING (m1, m2)""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    return evaluate.wilcoxon(error_pairs(c), "a", "b", ["m1", "m2"]).select("m1", "m2", "n", "w", half_up("z", 6).alias("z"))


@query(
    "m10_diebold_mariano",
    _PAIRS + f" SELECT m1, m2, count(*) AS n, {rnd('avg(abs(a) - abs(b))', 6)} AS mean, {rnd('avg(abs(a) - abs(b)) / (stddev_samp(abs(a) - abs(b)) / sqrt(count(*)))', 6)} AS t FROM p GROUP BY m1, m2",
    "prediction",
)
def _(c: Context) -> DataFrame:
    return evaluate.dm_test(error_pairs(c), "a", "b", ["m1", "m2"]).select("m1", "m2", "n", half_up("mean", 6).alias("mean"), half_up("t", 6).alias("t"))


@query(
    "m11_ttest",
    f"""SELECT n1 + n0 AS n, {rnd('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))', 6)} AS t FROM
        (SELECT count(*) FILTER (WHERE amueblado = 1) AS n1, avg(price) FILTER (WHERE amueblado = 1) AS m1, var_samp(price) FILTER (WHERE amueblado = 1) AS v1,
          count(*) FILTER (WHERE amueblado = 0) AS n0, avg(price) FILTER (WHERE amueblado = 0) AS m0, var_samp(price) FILTER (WHERE amueblado = 0) AS v0 FROM listing)""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return evaluate.ttest_ind(c.listing, "amueblado", "price").select("n", half_up("t", 6).alias("t"))


_CI = f", ci AS (SELECT model, avg(e) - 1.96 * stddev_samp(e) / sqrt(count(e)) AS lo, avg(e) + 1.96 * stddev_samp(e) / sqrt(count(e)) AS hi FROM (SELECT model, {_E} AS e FROM prediction) GROUP BY model)"


@query(
    "m12_ci_overlap",
    _CI + " SELECT a.model AS a, b.model AS b, a.lo <= b.hi AND b.lo <= a.hi AS overlap FROM ci a JOIN ci b ON a.model < b.model",
    "prediction",
)
def _(c: Context) -> DataFrame:
    e = evaluate.error_pct("precio_predicho", "precio_real")
    half = F.lit(1.96) * F.stddev_samp("e") / F.sqrt(F.count("e"))
    cis = c.prediction.select("model", e.alias("e")).groupBy("model").agg((F.avg("e") - half).alias("lo"), (F.avg("e") + half).alias("hi"))
    return evaluate.ci_overlap(cis)


@query(
    "m13_stars",
    "SELECT event_id, CASE WHEN value / 10000 < 0.001 THEN '***' WHEN value / 10000 < 0.01 THEN '**' WHEN value / 10000 < 0.05 THEN '*' ELSE 'n.s.' END AS sig FROM events",
)
def _(c: Context) -> DataFrame:
    return c.events.select("event_id", rules.stars(F.col("value") / 10000).alias("sig"))


@query("m14_residual_shape")
def _(c: Context) -> DataFrame:
    from valora.operators.models import residual_shape

    rows = c.prediction.filter("precio_predicho IS NOT NULL").select("model", (F.col("precio_real") - F.col("precio_predicho")).alias("res"))
    return residual_shape(rows, "res")


@query(
    "m15_run_delta",
    f""", m AS (SELECT split, model, avg({_E}) AS mae FROM prediction GROUP BY split, model)
        SELECT split, {rnd("max(mae) FILTER (WHERE model = 'a') - max(mae) FILTER (WHERE model = 'b')")} AS delta FROM m GROUP BY split""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    m = c.prediction.groupBy("split", "model").agg(F.avg(evaluate.error_pct("precio_predicho", "precio_real")).alias("mae"))
    return evaluate.delta_table(m, "model", "mae", "a", "b", ["split"]).select("split", half_up("delta").alias("delta"))


@query(
    "m16_answer_audit",
    f"SELECT id, {_price_sql('loose')} IS NOT NULL AS has_price, id % 10 <> 6 AS short, id % 10 <> 8 AS no_code FROM answer",
    "answer",
)
def _(c: Context) -> DataFrame:
    return evaluate.audit_answers(c.answer, "answer").select("id", "has_price", "short", "no_code")


@query("o4_tail_probabilities")
def _(c: Context) -> DataFrame:
    by_part = error_pairs(c).withColumn("part", F.col("id") % 20)
    tests = evaluate.mcnemar(by_part, "a", "b", 15.0, ["m1", "m2", "part"])
    got = evaluate.with_p_value(tests, "chi2", "chi2")
    return got.select("m1", "m2", "part", "n01", "n10", half_up("chi2", 6).alias("chi2"), half_up("p", 6).alias("p"), "sig")


@query("o5_target_transform", f"SELECT listing_id, {rnd('ln(1 + price)', 6)} AS log1p, {rnd('(pow(price, 0.5) - 1) / 0.5', 4)} AS boxcox, {rnd('price', 3)} AS back FROM listing", "listing")
def _(c: Context) -> DataFrame:
    fwd, _inv = numeric.target_transform("log1p")
    fwd2, inv2 = numeric.target_transform("boxcox", 0.5)
    p = F.col("price")
    return c.listing.select("listing_id", half_up(fwd(p), 6).alias("log1p"), half_up(fwd2(p), 4).alias("boxcox"), half_up(inv2(fwd2(p)), 3).alias("back"))


# ---- incremental, batch side --------------------------------------------------------------
@query(
    "n1_weekly_merge",
    f"""SELECT source_url, listing_id, {rnd('price', 2)} AS price FROM listing WHERE listing_id % 7 <> 0""",
    "listing",
)
def _(c: Context) -> DataFrame:
    # The base holds even ids; a new source repeats a third of them at another price and adds the odd ones.
    rows = c.listing.select("source_url", "listing_id", "price")
    base = rows.filter("listing_id % 2 = 0").withColumn("price", F.when(F.col("listing_id") % 7 == 0, 0.0).otherwise(F.col("price")))
    new = rows.filter("listing_id % 2 = 1 OR listing_id % 3 = 0").withColumn(
        "price", F.when(F.col("listing_id") % 2 == 0, F.col("price") + 1).when(F.col("listing_id") % 7 == 0, None).otherwise(F.col("price")))
    got = incremental.weekly_merge(base, new.withColumn("extra", F.lit("x")))
    return got.select("source_url", "listing_id", half_up("price", 2).alias("price"))


@query(
    "n4_skip_finished",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def _(c: Context) -> DataFrame:
    units = c.orders.select("o_custkey").distinct()
    return incremental.skip_finished(units, c.orders.filter("o_orderstatus = 'P'"), "o_custkey")


@query(
    "n5_market_pulse",
    f"""SELECT event_type, CAST(TIMESTAMP '1970-01-01' + to_days(CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS INT) * 7) AS DATE) AS week,
        {rnd('quantile_cont(value, 0.5)')} AS median, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def _(c: Context) -> DataFrame:
    got = incremental.market_pulse(c.events, "event_type", "ts", "value")
    return got.select("event_type", F.col("week").cast("date").alias("week"), half_up("median").alias("median"), "n")


