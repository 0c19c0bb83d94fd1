"""Queries for aggregations, windows and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed, numeric, parse, rules
from valora.functions.numeric import half_up
from valora.operators import aggregate, encode, evaluate, ordering, quantile, sampling, select
from valora.plans.catalog_relational import _ERR, _SEG
from valora.plans.registry import Context, query, rnd, sql_list, sql_unit
from valora.streaming import incremental


@query(
    "f1_global_stats",
    f"SELECT count(price) AS n, {rnd('min(price)', 2)} AS lo, {rnd('quantile_cont(price, 0.5)')} AS med, {rnd('max(price)', 2)} AS hi FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    q = quantile.exact_quantiles(c.listing, [], "price", {"lo": 0.0, "med": 0.5, "hi": 1.0})
    return q.select("n", half_up("lo", 2).alias("lo"), half_up("med").alias("med"), half_up("hi", 2).alias("hi"))


@query(
    "f2_group_median_topn",
    f"""SELECT colonia, {rnd('quantile_cont(price, 0.5)')} AS median, count(*) AS n FROM listing
        WHERE price BETWEEN 4500 AND (SELECT quantile_cont(price, 0.99) FROM listing)
        GROUP BY colonia HAVING count(*) >= 5 ORDER BY quantile_cont(price, 0.5) DESC, colonia LIMIT 15""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = select.price_window(c.stored("listing", "price", "location"))
    zone, _town = parse.split_location("location")
    top = aggregate.top_groups(rows.select(zone.alias("colonia"), "price"), "colonia", "price", 5, 15)
    return top.select("colonia", half_up("median").alias("median"), "n")


_KW = ["alberca", "gimnasio", "elevador", "seguridad", "amueblado", "inmobiliaria"]


@query(
    "f3_with_without",
    " UNION ALL ".join(
        f"SELECT '{w}' AS keyword, {rnd(f'''avg(price) FILTER (WHERE contains(lower(text), '{w}'))''', 2)} AS with_mean, "
        f"{rnd(f'''avg(price) FILTER (WHERE NOT contains(lower(text), '{w}'))''', 2)} AS without_mean FROM ad" for w in _KW),
    "ad",
)
def _(c: Context) -> DataFrame:
    rows = c.ad.select("price", F.lower("text").alias("t"))
    got = aggregate.with_without(rows, {w: F.col("t").contains(w) for w in _KW}, "price")
    return got.select("keyword", half_up("with_mean", 2).alias("with_mean"), half_up("without_mean", 2).alias("without_mean"))


_POPS = {"all": "true", "residential": "property_type = 'household'", "commercial": "property_type = 'building'"}


@query(
    "f4_flag_rates",
    " UNION ALL ".join(
        f"SELECT '{p}' AS population, '{f}' AS flag, {rnd(f'avg(CASE WHEN {f} = 1 THEN 1.0 ELSE 0.0 END) * 100')} AS pct FROM listing WHERE {cond}"
        for p, cond in _POPS.items() for f in ("lujo", "amueblado", "nuevo")),
    "listing",
)
def _(c: Context) -> DataFrame:
    got = aggregate.flag_rates(c.listing, ["lujo", "amueblado", "nuevo"], {p: F.expr(e) for p, e in _POPS.items()})
    return got.select("population", "flag", half_up("pct").alias("pct"))


@query("f5_value_counts", "SELECT colonia, count(*) AS n FROM listing GROUP BY colonia ORDER BY n DESC, colonia LIMIT 5", "listing")
def _(c: Context) -> DataFrame:
    return aggregate.value_counts(c.listing, "colonia", 5)


_Q = {"q025": 0.025, "q90": 0.9, "q95": 0.95, "q975": 0.975, "q99": 0.99}


@query(
    "f6_quantiles",
    "SELECT model, count(precio_predicho) AS n, " + ", ".join(f"{rnd(f'quantile_cont(precio_predicho, {p})', 3)} AS {k}" for k, p in _Q.items())
    + " FROM prediction GROUP BY model",
    "prediction",
)
def _(c: Context) -> DataFrame:
    got = quantile.exact_quantiles(c.prediction, ["model"], "precio_predicho", _Q)
    return got.select("model", "n", *[half_up(k, 3).alias(k) for k in _Q])


_CORR = ["price", "m2", "recamaras", "amueblado"]


@query(
    "f7_corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})', 6)} AS r FROM listing" for i, a in enumerate(_CORR) for b in _CORR[i:]),
    "listing",
)
def _(c: Context) -> DataFrame:
    return aggregate.corr_matrix(c.listing, _CORR).select("a", "b", half_up("r", 6).alias("r"))


def _hist_sql(x: str, bins: int) -> str:
    return f""", x AS (SELECT {x} AS x FROM listing WHERE {x} IS NOT NULL), s AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins}.0 AS w FROM x)
        SELECT CAST(least(floor((x - lo) / w), {bins - 1}) AS INT) AS bin, count(*) AS n, {rnd('min(x)')} AS low, {rnd('max(x)')} AS high FROM x, s GROUP BY 1"""


@query("f8_histogram", _hist_sql("price", 30), "listing")
def _(c: Context) -> DataFrame:
    return aggregate.histogram(c.listing, "price", 30).select("bin", "n", half_up("low").alias("low"), half_up("high").alias("high"))


@query("f8_histogram_log", _hist_sql("ln(1 + price)", 20), "listing")
def _(c: Context) -> DataFrame:
    # ln(1 + x), spelled as in the check so that values on a bin edge fall alike.
    return aggregate.histogram(c.listing, F.log(1 + F.col("price")), 20).select(
        "bin", "n", half_up("low").alias("low"), half_up("high").alias("high"))


@query(
    "f9_box_stats",
    f""", q AS (SELECT recamaras, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) AS q3, count(*) AS n
          FROM listing WHERE price IS NOT NULL GROUP BY recamaras)
        SELECT l.recamaras AS recamaras, n, {rnd('q1')} AS q1, {rnd('med')} AS med, {rnd('q3')} AS q3,
          {rnd('min(price) FILTER (WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS low,
          {rnd('max(price) FILTER (WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS high,
          count(*) FILTER (WHERE NOT price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM listing l JOIN q ON l.recamaras IS NOT DISTINCT FROM q.recamaras GROUP BY ALL""",
    "listing",
)
def _(c: Context) -> DataFrame:
    got = aggregate.box_stats(c.stored("listing", "recamaras", "price"), "recamaras", "price")
    return got.select("recamaras", "n", *[half_up(x).alias(x) for x in ("q1", "med", "q3", "low", "high")], "outliers")


@query(
    "f10_group_profile",
    f"SELECT municipio, {rnd('avg(price)', 0)} AS price, {rnd('avg(m2)', 0)} AS m2, {rnd('avg(lujo)', 2)} AS lujo FROM listing GROUP BY municipio",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.groupBy("municipio").agg(
        half_up(F.avg("price"), 0).alias("price"), half_up(F.avg("m2"), 0).alias("m2"), half_up(F.avg("lujo"), 2).alias("lujo"))


@query(
    "f11_arg_max_group",
    """SELECT (SELECT colonia FROM listing GROUP BY colonia ORDER BY avg(price) DESC, colonia LIMIT 1) AS dearest,
       (SELECT recamaras FROM listing GROUP BY recamaras ORDER BY count(*) DESC, recamaras LIMIT 1) AS mode_rooms""",
    "listing",
)
def _(c: Context) -> DataFrame:
    means = c.listing.groupBy("colonia").agg(F.avg("price").alias("m"))
    mode = aggregate.value_counts(c.listing, "recamaras", 1)
    return means.agg(F.max_by("colonia", "m").alias("dearest")).select("dearest", mode.select("recamaras").scalar().alias("mode_rooms"))


_SIGNALS = {**fixed.STUDENT_SIGNALS, **fixed.SENIOR_SIGNALS}


@query(
    "f12_keyword_signals",
    " UNION ALL ".join(f"SELECT '{n}' AS signal, count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS n FROM ad" for n, p in _SIGNALS.items()),
    "ad",
)
def _(c: Context) -> DataFrame:
    return aggregate.signal_counts(c.ad, "text", _SIGNALS)


def _words_sql(pre: int | None, k: int, stop, table: str) -> str:
    base = f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '([a-záéíóúüñ]{{4,}})', 1)) AS word FROM {table}),
        n AS (SELECT word, count(*) AS n FROM t GROUP BY word ORDER BY n DESC, word{f' LIMIT {pre}' if pre else ''})"""
    return base + f" SELECT word, n FROM n WHERE word NOT IN (SELECT unnest({sql_list(stop)})) ORDER BY n DESC, word LIMIT {k}"


@query("f13_word_counts", _words_sql(200, 10, fixed.TOKEN_STOPWORDS, "documents"))
def _(c: Context) -> DataFrame:
    return aggregate.word_counts(c.documents, parse.tokenize("text", "letters4"), fixed.TOKEN_STOPWORDS, 200, 10)


@query(
    "f13_word_cloud",
    f"""WITH t AS (SELECT unnest(string_split_regex(regexp_replace(lower(text), '[^a-záéíóúüñ\\s]', ' ', 'g'), '\\s+')) AS word FROM documents)
        SELECT word, count(*) AS n FROM t WHERE word <> '' AND word NOT IN (SELECT unnest({sql_list(fixed.CLOUD_STOPWORDS)})) GROUP BY word ORDER BY n DESC, word LIMIT 120""",
)
def _(c: Context) -> DataFrame:
    return aggregate.word_counts(c.documents, parse.tokenize("text", "letters"), fixed.CLOUD_STOPWORDS, None, 120)


@query(
    "f14_coverage",
    " UNION ALL ".join(f"SELECT '{x}' AS name, count({x}) AS present, {rnd(f'count({x}) * 100.0 / count(*)')} AS pct FROM listing" for x in ("m2", "recamaras", "amueblado", "price")),
    "listing",
)
def _(c: Context) -> DataFrame:
    return aggregate.coverage(c.listing, ["m2", "recamaras", "amueblado", "price"]).select("name", "present", half_up("pct").alias("pct"))


@query(
    "f15_segment_table",
    f""", s AS (SELECT {_SEG} AS segment, price, m2, recamaras FROM ad),
        a AS (SELECT segment, count(*)::DOUBLE AS n, min(price) AS min_price, max(price) AS max_price, avg((recamaras > 3)::INT) * 100 AS pct_big, quantile_cont(price, 0.5) AS median_price FROM s GROUP BY segment),
        u AS (SELECT segment, unnest(['n', 'min_price', 'max_price', 'pct_big', 'median_price']) AS metric, unnest([n, min_price, max_price, pct_big, median_price]) AS v FROM a)
        SELECT metric, {', '.join(rnd(f"max(v) FILTER (WHERE segment = '{s}')") + f' AS {s}' for s in ('student', 'senior', 'general'))} FROM u GROUP BY metric""",
    "ad",
)
def _(c: Context) -> DataFrame:
    rows = c.ad.select(rules.segment_by_text("text").alias("segment"), "price", (F.col("recamaras") > 3).cast("int").alias("big"))
    got = aggregate.segment_table(rows, "segment", "price", ["big"], ["student", "senior", "general"])
    return got.select("metric", *[half_up(s).alias(s) for s in ("student", "senior", "general")])


_RUNS = f", runs AS (SELECT model, split, avg({_ERR}) AS mae FROM prediction GROUP BY model, split)"


def run_metrics(c: Context) -> DataFrame:
    return c.prediction.groupBy("model", "split").agg(F.avg(F.expr(_ERR)).alias("mae"))


@query(
    "f16_run_summary",
    _RUNS + f" SELECT model, {rnd('avg(mae)', 2)} AS mean, {rnd('stddev_pop(mae)', 2)} AS sd, count(*) AS runs FROM runs GROUP BY model",
    "prediction",
)
def _(c: Context) -> DataFrame:
    return evaluate.run_summary(run_metrics(c), ["model"], "mae")


@query(
    "f17_order_preserved",
    _RUNS + """ SELECT count(*) FILTER (WHERE a >= b) AS preserved, count(*) AS runs
        FROM (SELECT split, max(mae) FILTER (WHERE model = 'a') AS a, max(mae) FILTER (WHERE model = 'b') AS b FROM runs GROUP BY split)""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    return evaluate.order_preserved(run_metrics(c), "split", "model", "mae", "a", "b")


@query(
    "f18_pct_change",
    f"""SELECT a.recamaras AS recamaras, {rnd('a.m', 2)} AS mean, {rnd('(a.m - b.m) / b.m * 100')} AS change_pct
        FROM (SELECT recamaras, avg(price) AS m FROM listing WHERE nuevo = 1 GROUP BY recamaras) a
        JOIN (SELECT recamaras, avg(price) AS m FROM listing WHERE nuevo = 0 GROUP BY recamaras) b ON a.recamaras = b.recamaras""",
    "listing",
)
def _(c: Context) -> DataFrame:
    mean = lambda flag: c.listing.filter(F.col("nuevo") == flag).groupBy("recamaras").agg(F.avg("price").alias("mean"))
    got = aggregate.pct_change(mean(1), mean(0), "recamaras", "mean")
    return got.select("recamaras", half_up("mean", 2).alias("mean"), half_up("change_pct").alias("change_pct"))


_BIN = """CASE WHEN precio_real > 0 AND precio_real <= 50000 THEN 'a' WHEN precio_real <= 150000 THEN 'b' WHEN precio_real <= 300000 THEN 'c' WHEN precio_real <= 400000 THEN 'd' END"""


@query(
    "f19_error_by_bin",
    f"""SELECT bin, {rnd('avg(err)')} AS mean_err, count(*) AS n, {rnd('quantile_cont(precio_predicho, 0.5)', 2)} AS median_pred, {rnd('quantile_cont(precio_real, 0.5)', 2)} AS median_real
        FROM (SELECT {_BIN} AS bin, {_ERR} AS err, precio_predicho, precio_real FROM prediction) WHERE bin IS NOT NULL AND err IS NOT NULL GROUP BY bin""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    rows = c.prediction.withColumn("err", F.expr(_ERR)).withColumn(
        "bin", numeric.cut("precio_real", [0, 50_000, 150_000, 300_000, 400_000], ["a", "b", "c", "d"]))
    got = evaluate.error_by_bin(rows, "bin", "precio_predicho", "precio_real", "err")
    return got.select("bin", half_up("mean_err").alias("mean_err"), "n", half_up("median_pred", 2).alias("median_pred"), half_up("median_real", 2).alias("median_real"))


_NAMED = ["NATION_1", "NATION_7", "NATION_13", "NATION_22"]


@query(
    "f20_named_zones",
    f"""SELECT colonia, {rnd('quantile_cont(price, 0.5)')} AS median, quantile_cont(price, 0.5) > (SELECT quantile_cont(price, 0.5) FROM listing) AS above
        FROM listing WHERE colonia IN (SELECT unnest({sql_list(_NAMED)})) GROUP BY colonia""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.stored("listing", "colonia", "price")
    city = quantile.scalar_quantile(rows, "price", 0.5)
    zones = quantile.exact_median(rows.filter(F.col("colonia").isin(_NAMED)), ["colonia"], "price")
    return zones.select("colonia", half_up("median").alias("median"), (F.col("median") > city).alias("above"))


@query(
    "f21_quarter_change",
    f"""SELECT colonia, q AS quarter, {rnd('m', 2)} AS mean, {rnd('(m - prev) / prev * 100')} AS change_pct FROM
        (SELECT colonia, q, m, lag(m) OVER (PARTITION BY colonia ORDER BY q) AS prev FROM
          (SELECT colonia, CAST(date_trunc('quarter', published) AS DATE) AS q, avg(price) AS m FROM listing GROUP BY 1, 2))""",
    "listing",
)
def _(c: Context) -> DataFrame:
    from pyspark.sql import Window as W

    # One row per zone and quarter enters the window.
    m = c.listing.groupBy("colonia", F.date_trunc("quarter", F.col("published")).cast("date").alias("quarter")).agg(F.avg("price").alias("m"))
    prev = F.lag("m").over(W.partitionBy("colonia").orderBy("quarter"))
    return m.withColumn("prev", prev).select("colonia", "quarter", half_up("m", 2).alias("mean"), half_up((F.col("m") - F.col("prev")) / F.col("prev") * 100).alias("change_pct"))


@query(
    "f21_days_on_market",
    f"""SELECT colonia, {rnd("quantile_cont(date_diff('day', CAST(published AS DATE), DATE '2000-01-01'), 0.5)")} AS median, count(*) AS n FROM listing GROUP BY colonia""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.select("colonia", numeric.age_days("published", "2000-01-01", fixed.DEFAULT_AGE_DAYS).alias("days"))
    return quantile.exact_median(rows, ["colonia"], "days").select("colonia", half_up("median").alias("median"), "n")


@query("f22_question_counts", "SELECT split, model AS tipo, count(*) AS n FROM prediction GROUP BY split, model", "prediction")
def _(c: Context) -> DataFrame:
    return c.prediction.groupBy("split", F.col("model").alias("tipo")).agg(F.count("*").alias("n"))


@query(
    "f23_threshold_accuracy",
    f""", x AS (SELECT CASE id % 3 WHEN 0 THEN 'robustez' WHEN 1 THEN 'tendencia' ELSE 'precio_m2' END AS kind, trim(answer) = '' AS empty, (id % 100) / 100.0 > 0.33 AS ok FROM answer)
        SELECT kind, {rnd('avg(ok::INT) FILTER (WHERE NOT empty) * 100')} AS accuracy, count(*) FILTER (WHERE NOT empty) AS n FROM x GROUP BY kind
        UNION ALL SELECT 'TOTAL', {rnd('avg((ok AND NOT empty)::INT) * 100')}, count(*) FROM x""",
    "answer",
)
def _(c: Context) -> DataFrame:
    rows = c.answer.select(
        F.expr("CASE id % 3 WHEN 0 THEN 'robustez' WHEN 1 THEN 'tendencia' ELSE 'precio_m2' END").alias("kind"), "answer",
        (F.col("id") % 100 / 100.0).alias("score"))
    return evaluate.threshold_accuracy(rows, "kind", "answer", "score").withColumn("accuracy", half_up("accuracy"))


# ---- windows ------------------------------------------------------------------------------
@query(
    "g1_dedupe_first",
    """SELECT key, o_orderkey, prio FROM (SELECT key, o_orderkey, prio, row_number() OVER (PARTITION BY key ORDER BY prio, o_orderkey) AS rn FROM
        (SELECT CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS key, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS prio FROM orders)) WHERE rn = 1""",
)
def _(c: Context) -> DataFrame:
    # A third of the rows have no key and form one group.
    rows = c.orders.select(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("key"), "o_orderkey",
                           F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("prio"))
    return incremental.dedupe_first(rows, "key", ["prio", "o_orderkey"])


@query(
    "g2_relative_to_group",
    f"""SELECT listing_id, {rnd('m')} AS group_median, {rnd('price / m', 6)} AS rel FROM listing JOIN
        (SELECT colonia AS k, quantile_cont(price, 0.5) AS m FROM listing GROUP BY 1) ON colonia = k""",
    "listing",
)
def _(c: Context) -> DataFrame:
    got = aggregate.relative_to_group(c.stored("listing", "listing_id", "colonia", "price"), "colonia", "price", "rel")
    return got.select("listing_id", half_up("group_median").alias("group_median"), half_up("rel", 6).alias("rel"))


@query(
    "g3_rare_bucket",
    """SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source) >= 10 THEN source ELSE 'Otras' END AS bucket FROM documents""",
)
def _(c: Context) -> DataFrame:
    return aggregate.rare_bucket(c.documents.select("doc_id", "source"), "source", 10, "Otras", "bucket").select("doc_id", "bucket")


@query(
    "g4_winsorize_by_group",
    f"""SELECT listing_id, {rnd('CASE WHEN x IS NOT NULL THEN least(x, cap) END')} AS pm2 FROM (SELECT listing_id, property_type, price / m2 AS x FROM listing) l
        JOIN (SELECT property_type AS k, quantile_cont(price / m2, 0.95) AS cap FROM listing GROUP BY 1) ON property_type = k""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.stored("listing", "listing_id", "property_type", "price", "m2")
    rows = rows.select("listing_id", "property_type", numeric.price_per_m2("price", "m2").alias("pm2"))
    return aggregate.winsorize_by(rows, "property_type", "pm2", 0.95).select("listing_id", half_up("pm2").alias("pm2"))


@query(
    "g5_average_ranks",
    """SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem""",
)
def _(c: Context) -> DataFrame:
    return evaluate.average_ranks(c.lineitem, "l_quantity", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank")


@query("g6_renumber", f"SELECT listing_id, row_number() OVER (ORDER BY {sql_unit('listing_id', 42)}, listing_id) AS id_seq FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return sampling.renumber(c.listing.select("listing_id"), "listing_id", 42)


@query(
    "g7_nested_subsets",
    f"""SELECT doc_id, size FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql_unit('doc_id', 42)}, doc_id) AS rn FROM documents), (VALUES (50), (100), (200)) s(size) WHERE rn <= size""",
)
def _(c: Context) -> DataFrame:
    return sampling.nested_subsets(c.documents.select("doc_id"), "doc_id", [50, 100, 200], 42).select("doc_id", "size")


@query("g9_qq_points")
def _(c: Context) -> DataFrame:
    # Residuals against normal quantiles, and the line fitted through them.
    rows = c.prediction.filter("model = 'a' AND precio_predicho IS NOT NULL").select("id", (F.col("precio_real") - F.col("precio_predicho")).alias("res"))
    ranked = ordering.numbered(rows, [], [F.col("res"), F.col("id")], "i")
    n = rows.agg(F.count("*")).scalar()
    q = encode.normal_quantile(encode.filliben(F.col("i"), n))
    points = ranked.withColumn("q", q)
    line = points.agg(F.struct(F.regr_slope("res", "q").alias("slope"), F.regr_intercept("res", "q").alias("intercept")).alias("l")).scalar()
    return points.select("id", "i", half_up("q", 6).alias("q"), half_up("res", 4).alias("res"),
                         half_up(line["slope"] * F.col("q") + line["intercept"], 3).alias("fitted"))


# ---- chart tables -------------------------------------------------------------------------
@query(
    "a21_chart_tables",
    f"""SELECT 'price_by_type' AS chart, property_type AS label, {rnd('quantile_cont(price, 0.5)', 2)} AS value FROM listing GROUP BY property_type
        UNION ALL SELECT 'share_furnished', property_type, {rnd('avg(CASE WHEN amueblado = 1 THEN 1.0 ELSE 0 END) * 100', 2)} FROM listing GROUP BY property_type""",
    "listing",
)
def _(c: Context) -> DataFrame:
    med = quantile.exact_median(c.listing, ["property_type"], "price", "value")
    share = c.listing.groupBy("property_type").agg((F.avg(F.coalesce(F.col("amueblado") == 1, F.lit(False)).cast("int")) * 100).alias("value"))
    out = med.select(F.lit("price_by_type").alias("chart"), F.col("property_type").alias("label"), "value").unionByName(
        share.select(F.lit("share_furnished").alias("chart"), F.col("property_type").alias("label"), "value"))
    return out.withColumn("value", half_up("value", 2))


