"""Queries for filters, segments, joins, sorts, set operations and sampling."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed, parse, rules
from valora.functions.numeric import half_up
from valora.operators import encode, joins, ordering, sampling, segment, select
from valora.plans.registry import Context, query, rnd, sql_unit


# ---- filters ------------------------------------------------------------------------------
@query(
    "c1_price_window",
    """SELECT listing_id, price FROM listing WHERE price BETWEEN 4500 AND (SELECT quantile_cont(price, 0.99) FROM listing)""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return select.price_window(c.listing.select("listing_id", "price"))


@query(
    "c2_trim_quantile",
    """SELECT listing_id, m2 FROM listing WHERE m2 < (SELECT quantile_cont(m2, 0.95) FROM listing)
       UNION ALL SELECT -listing_id, m2 FROM listing WHERE m2 <= (SELECT quantile_cont(m2, 0.95) FROM listing)""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.select("listing_id", "m2")
    loose = select.trim_q(rows, "m2", 0.95, strict=False).withColumn("listing_id", -F.col("listing_id"))
    return select.trim_q(rows, "m2", 0.95).unionByName(loose)


@query("c3_valid_price", "SELECT event_id, value FROM events WHERE value > 0")
def _(c: Context) -> DataFrame:
    return select.valid_price(c.events.select("event_id", "value"), "value")


@query("c4_price_cap", "SELECT listing_id, price FROM listing WHERE price <= 500000", "listing")
def _(c: Context) -> DataFrame:
    return select.price_cap(c.listing.select("listing_id", "price"))


@query("c5_category_filter", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'household')")
def _(c: Context) -> DataFrame:
    return c.customer.filter(select.in_category("c_mktsegment", ["building", "household"])).select("c_custkey")


@query("c6_complete_cases", "SELECT listing_id FROM listing WHERE m2 IS NOT NULL AND amueblado IS NOT NULL AND price IS NOT NULL", "listing")
def _(c: Context) -> DataFrame:
    return select.complete_cases(c.listing, ["m2", "amueblado", "price"]).select("listing_id")


@query(
    "c7_keyword_filter",
    f"""SELECT listing_id AS id FROM ad WHERE regexp_matches(lower(text), '{fixed.KW_RULE_STUDENT}')
        UNION ALL SELECT -doc_id FROM documents WHERE regexp_matches(lower(text), 'with|para|ción')""",
    "ad",
)
def _(c: Context) -> DataFrame:
    ads = c.ad.filter(parse.matches("text", fixed.KW_RULE_STUDENT)).select(F.col("listing_id").alias("id"))
    docs = c.documents.filter(parse.matches("text", "with|para|ción")).select((-F.col("doc_id")).alias("id"))
    return ads.unionByName(docs)


@query(
    "c8_search_leads",
    """SELECT listing_id FROM listing WHERE lujo > 0 AND contains(lower(concat_ws('', colonia, municipio, property_type)), 'asiab')""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return select.search_leads(c.listing, "lujo", ["colonia", "municipio", "property_type"], "ASIAb ").select("listing_id")


@query(
    "c9_min_support",
    "SELECT colonia, recamaras, count(*) AS n FROM listing GROUP BY colonia, recamaras HAVING count(*) >= 10",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.groupBy("colonia", "recamaras").agg(F.count("*").alias("n")).filter("n >= 10")


@query("c10_drop_tiny_examples", "SELECT conv_id, turn FROM conversations WHERE length(json_object('role', role, 'content', text)) > 200 - 13")
def _(c: Context) -> DataFrame:
    # {"messages":…} adds thirteen characters around the turn itself.
    turns = c.conversations.withColumn("messages", F.struct("role", F.col("text").alias("content")))
    return select.long_enough(turns, "messages").select("conv_id", "turn")


@query("c11_rooms_in_set", "SELECT listing_id FROM listing WHERE price BETWEEN 8000 AND 150000 AND coalesce(recamaras, 0) IN (0, 1, 2, 3)", "listing")
def _(c: Context) -> DataFrame:
    return c.listing.filter(F.col("price").between(8000, 150000) & select.rooms_in("recamaras", [0, 1, 2, 3])).select("listing_id")


# ---- segments -----------------------------------------------------------------------------
_SENIOR_RE = f"{fixed.KW_ACCESS}|{fixed.KW_SECURITY}|{fixed.KW_QUIET}"
_SEG = f"""CASE WHEN regexp_matches(lower(text), '{fixed.KW_STUDENT}') THEN 'student'
    WHEN regexp_matches(lower(text), '{_SENIOR_RE}') THEN 'senior' ELSE 'general' END"""


@query("d1_segment_by_text", f"SELECT listing_id, {_SEG} AS segment FROM ad", "ad")
def _(c: Context) -> DataFrame:
    return c.ad.select("listing_id", rules.segment_by_text("text").alias("segment"))


@query(
    "d2_segment_overlap",
    f"""SELECT CAST(sum(s::INT) AS BIGINT) AS n_student, CAST(sum(m::INT) AS BIGINT) AS n_senior, CAST(sum((s AND m)::INT) AS BIGINT) AS n_both,
        CAST(sum((NOT s AND NOT m)::INT) AS BIGINT) AS n_rest
        FROM (SELECT regexp_matches(lower(text), '{fixed.KW_STUDENT}') AS s, regexp_matches(lower(text), '{_SENIOR_RE}') AS m FROM ad)""",
    "ad",
)
def _(c: Context) -> DataFrame:
    flags = c.ad.select(parse.matches("text", fixed.KW_STUDENT).alias("s"), parse.matches("text", _SENIOR_RE).alias("m"))
    return flags.agg(F.count_if("s").alias("n_student"), F.count_if("m").alias("n_senior"),
                     F.count_if(F.col("s") & F.col("m")).alias("n_both"), F.count_if(~F.col("s") & ~F.col("m")).alias("n_rest"))


_PTYPE = "CASE WHEN property_type IN ('building', 'household') THEN ' Casa ' ELSE property_type END"
_RE = {
    "kw_student": fixed.KW_RULE_STUDENT, "kw_access": fixed.KW_RULE_ACCESS, "kw_security": fixed.KW_RULE_SECURITY,
    "kw_quiet": fixed.KW_RULE_QUIET, "kw_comfort": fixed.KW_RULE_COMFORT,
}
_FLAGS = f""", f AS (SELECT listing_id, price / 10 AS price, recamaras, coalesce(recamaras, 0) AS r0,
    property_type IN ('building', 'household') AS home, {', '.join(f"regexp_matches(lower(text), '{p}') AS {n}" for n, p in _RE.items())} FROM ad),
    g AS (SELECT *, home AND price <= 18000 AND (r0 IN (0, 1, 2) OR kw_student) AS st,
      home AND price BETWEEN 8000 AND 35000 AND r0 IN (0, 1, 2, 3) AND (kw_access OR kw_security OR kw_quiet OR kw_comfort) AS se FROM f)"""


def rule_segments(c: Context) -> DataFrame:
    rows = c.ad.select("listing_id", (F.col("price") / 10).alias("price"), "recamaras", "text", F.expr(_PTYPE).alias("property_type"))
    flags = rules.segment_flags("text", "price", "recamaras", "property_type")
    return rows.select("*", *[e.alias(n) for n, e in flags.items()])


@query(
    "d3_segment_by_rules",
    _FLAGS + " SELECT listing_id, CASE WHEN st THEN 'student' WHEN se THEN 'senior' ELSE 'general' END AS segment FROM g",
    "ad",
)
def _(c: Context) -> DataFrame:
    return rule_segments(c).select("listing_id", rules.segment_from_flags().alias("segment"))


_MONEY = r"concat('precio $', CASE WHEN q < 1000 THEN CAST(q AS VARCHAR) ELSE regexp_replace(CAST(q AS VARCHAR), '(\d)(\d{3})$', '\1,\2') END)"


@query(
    "d4_segment_reason",
    _FLAGS + f""", h AS (SELECT *, CAST(floor(price + 0.5) AS BIGINT) AS q FROM g)
    SELECT listing_id, CASE WHEN st THEN concat_ws(' | ', {_MONEY}, CASE WHEN kw_student THEN 'keyword universitario' END,
        CASE WHEN recamaras IN (0, 1, 2) THEN concat(recamaras, ' rec.') END)
      WHEN se THEN concat_ws(' | ', CASE WHEN kw_access THEN 'accesibilidad' END, CASE WHEN kw_security THEN 'seguridad 24h' END,
        CASE WHEN kw_quiet THEN 'zona tranquila' END, CASE WHEN kw_comfort THEN 'jardín/patio' END, {_MONEY}) ELSE '' END AS reason FROM h""",
    "ad",
)
def _(c: Context) -> DataFrame:
    return rule_segments(c).select("listing_id", rules.segment_reason("price", "recamaras").alias("reason"))


def scored_leads(c: Context) -> DataFrame:
    text = F.lower("text")
    rows = c.ad.select(
        "listing_id", (F.col("price") / 5).alias("price"), F.col("text").alias("description"), F.col("recamaras").alias("bedrooms"),
        F.when(F.col("property_type") == "household", "casa").when(F.col("property_type") == "building", "oficina").otherwise("otro").alias("property_type"),
        F.when(F.col("colonia") == "NATION_3", "Cumbres").otherwise(F.col("colonia")).alias("colonia"),
        text.contains("amueblado").cast("int").alias("furnished"), text.contains("elevador").cast("int").alias("has_elevator"),
        text.contains("seguridad 24").cast("int").alias("has_security_24h"), text.contains("gimnasio").cast("int").alias("has_gym"),
        text.contains("alberca").cast("int").alias("has_pool"), text.contains("jardín").cast("int").alias("has_garden"),
        F.when(text.contains("planta baja"), 0).alias("floor"),
        (F.col("listing_id") % 3 == 0).cast("int").alias("has_lobby"), (F.col("listing_id") % 4 == 0).cast("int").alias("has_minisplit_ac"),
        F.when(F.col("listing_id") % 5 > 0, (F.col("listing_id") % 5 == 1).cast("int")).alias("allows_pets"),
        (F.col("listing_id") % 6 == 0).cast("int").alias("has_sala_juntas"), (F.col("listing_id") % 7 == 0).cast("int").alias("has_coworking"),
        F.when(F.col("listing_id") % 3 == 1, F.col("listing_id").cast("string")).alias("phone"),
    )
    return segment.with_scores(rows)


_ON = {
    "furnished": "contains(t, 'amueblado')", "has_elevator": "contains(t, 'elevador')", "has_security_24h": "contains(t, 'seguridad 24')",
    "has_gym": "contains(t, 'gimnasio')", "has_pool": "contains(t, 'alberca')", "has_garden": "contains(t, 'jardín')",
    "has_lobby": "listing_id % 3 = 0", "has_minisplit_ac": "listing_id % 4 = 0", "allows_pets": "listing_id % 5 = 1",
    "has_sala_juntas": "listing_id % 6 = 0", "has_coworking": "listing_id % 7 = 0",
}


def _score_sql(terms) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0 END" for cond, w in terms)


_STUDENT_SQL = _score_sql([
    (_ON["furnished"], 3), ("kind = 'casa'", 2), (f"regexp_matches(t, '{fixed.SCORE_STUDENT}')", 4), (_ON["has_minisplit_ac"], 1),
    ("recamaras IN (1, 2)", 1), (_ON["allows_pets"], 1),
]) + " + CASE WHEN price <= 12000 THEN 3 WHEN price <= 18000 THEN 2 WHEN price <= 25000 THEN 1 ELSE 0 END"
_SENIOR_SQL = _score_sql([
    (_ON["has_elevator"], 4), ("contains(t, 'planta baja')", 3), (_ON["has_security_24h"], 3), (_ON["has_lobby"], 1), ("kind = 'casa'", 2),
    (f"regexp_matches(t, '{fixed.SCORE_SENIOR}')", 3), ("price <= 30000", 2), (_ON["has_gym"], 1), (_ON["has_garden"], 1), (_ON["furnished"], 1),
])
_RELOCATION_SQL = _score_sql([
    (_ON["furnished"], 4), (_ON["has_security_24h"], 3), (_ON["has_gym"], 2), (_ON["has_pool"], 2), (_ON["has_elevator"], 2), (_ON["has_lobby"], 1),
    (_ON["has_sala_juntas"], 1), (_ON["has_coworking"], 1), ("kind = 'oficina'", 1), ("colonia = 'NATION_3'", 3),
    (f"regexp_matches(t, '{fixed.SCORE_RELOCATION}')", 3), ("price >= 25000", 2), ("price >= 50000", 1),
])
_SCORED = f""", s AS (SELECT *, {_STUDENT_SQL} AS score_student, {_SENIOR_SQL} AS score_senior, {_RELOCATION_SQL} AS score_relocation
    FROM (SELECT listing_id, price / 5 AS price, lower(text) AS t, recamaras, colonia,
      CASE property_type WHEN 'household' THEN 'casa' WHEN 'building' THEN 'oficina' ELSE 'otro' END AS kind FROM ad)),
    long AS (SELECT listing_id, price, 'student' AS segment, score_student AS score FROM s UNION ALL SELECT listing_id, price, 'senior', score_senior FROM s
      UNION ALL SELECT listing_id, price, 'relocation', score_relocation FROM s)"""


@query("d5_score_student", _SCORED + " SELECT listing_id, score_student AS score FROM s", "ad")
def _(c: Context) -> DataFrame:
    return scored_leads(c).select("listing_id", F.col("score_student").alias("score"))


@query("d6_score_senior", _SCORED + " SELECT listing_id, score_senior AS score FROM s", "ad")
def _(c: Context) -> DataFrame:
    return scored_leads(c).select("listing_id", F.col("score_senior").alias("score"))


@query("d7_score_relocation", _SCORED + " SELECT listing_id, score_relocation AS score FROM s", "ad")
def _(c: Context) -> DataFrame:
    return scored_leads(c).select("listing_id", F.col("score_relocation").alias("score"))


@query(
    "d8_best_segment",
    _SCORED + """ SELECT greatest(score_student, score_senior, score_relocation) AS best_score, count(*) AS n,
        CAST(sum((score_student > 5)::INT) AS BIGINT) AS n_student FROM s GROUP BY 1""",
    "ad",
)
def _(c: Context) -> DataFrame:
    best = segment.best_segment(scored_leads(c))
    return best.groupBy("best_score").agg(F.count("*").alias("n"), F.count_if(F.col("score_student") > 5).alias("n_student"))


_RANKED = _SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, listing_id) AS rank FROM long)"""


@query("d9_top_per_profile", _RANKED + " SELECT segment, CAST(rank AS INT) AS rank, listing_id, score FROM r WHERE rank <= 30", "ad")
def _(c: Context) -> DataFrame:
    return segment.ranking(scored_leads(c), "listing_id", 30).select("segment", "rank", "listing_id", "score")


@query(
    "d10_consolidated_ranking",
    _RANKED + f" SELECT segment, listing_id, score, {rnd('price', 2)} AS price FROM r WHERE rank <= 15",
    "ad",
)
def _(c: Context) -> DataFrame:
    got = segment.ranking(scored_leads(c), "listing_id", 15, ["price"])
    return got.select("segment", "listing_id", "score", half_up("price", 2).alias("price"))


@query(
    "d11_segment_summary",
    _SCORED + f""" SELECT segment, count(*) AS n, max(score) AS max_score, {rnd('quantile_cont(price, 0.5)')} AS median_price,
        count(CASE WHEN listing_id % 3 = 1 THEN 1 END) AS with_phone FROM long GROUP BY segment""",
    "ad",
)
def _(c: Context) -> DataFrame:
    long = segment.scores_long(scored_leads(c), ["listing_id", "price", "phone"])
    got = segment.segment_summary(long)
    return got.select("segment", "n", "max_score", half_up("median_price").alias("median_price"), "with_phone")


@query(
    "d12_valuation_flags",
    f"""SELECT id, model, {rnd('d')} AS diff_pct, d > 20 AS over, d < -20 AS under
        FROM (SELECT id, model, (precio_real - precio_predicho) / precio_predicho * 100 AS d FROM prediction)""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    got = segment.valuation_flags(c.prediction, "precio_real", "precio_predicho")
    return got.select("id", "model", half_up("diff_pct").alias("diff_pct"), "over", "under")


@query(
    "d13_cluster_tags",
    """SELECT colonia AS cluster, concat_ws(', ', CASE WHEN avg(price) > (SELECT quantile_cont(price, 0.5) FROM listing) * 1.2 THEN 'precio alto' ELSE 'precio bajo' END,
        CASE WHEN avg(lujo) > 0.5 THEN 'lujo' END, CASE WHEN avg(amueblado) > 0.5 THEN 'amueblado' END) AS tags FROM listing GROUP BY colonia""",
    "listing",
)
def _(c: Context) -> DataFrame:
    profile = c.listing.groupBy(F.col("colonia").alias("cluster")).agg(*[F.avg(x).alias(x) for x in ("price", "lujo", "amueblado")])
    return segment.cluster_tags(profile, c.listing, "price", ["lujo", "amueblado"]).select("cluster", "tags")


_CAND = f""", k AS (SELECT listing_id, views, {_SEG} AS segment FROM ad),
    cand AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY views DESC, listing_id) AS rank FROM k WHERE segment <> 'general')"""


def candidates(c: Context) -> DataFrame:
    rows = c.ad.select("listing_id", "views", rules.segment_by_text("text").alias("segment")).filter("segment <> 'general'")
    return segment.candidates(rows, "segment", "views", "listing_id", 40)


@query("d14_candidates", _CAND + " SELECT segment, CAST(rank AS INT) AS rank, listing_id FROM cand WHERE rank <= 40", "ad")
def _(c: Context) -> DataFrame:
    return candidates(c).select("segment", "rank", "listing_id")


@query(
    "g8_stop_after_goal",
    _CAND + """, w AS (SELECT segment, rank, listing_id, coalesce(sum((listing_id % 3 = 0)::INT) OVER (PARTITION BY segment ORDER BY rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cand WHERE rank <= 40)
        SELECT segment, CAST(rank AS INT) AS rank, listing_id, CAST(before AS BIGINT) AS found_before FROM w WHERE before < 5""",
    "ad",
)
def _(c: Context) -> DataFrame:
    ranked = candidates(c).withColumn("valid", F.col("listing_id") % 3 == 0)
    return segment.stop_after_goal(ranked, "segment", "rank", "valid", 5).select("segment", "rank", "listing_id", "found_before")


# ---- joins --------------------------------------------------------------------------------
def contacts(c: Context) -> DataFrame:
    return c.listing.filter("listing_id % 3 = 0").select(
        "source_url", F.concat(F.lit("81"), F.lpad(F.col("listing_id").cast("string"), 8, "0")).alias("telefono"))


@query(
    "e1_attach_contacts",
    """SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN concat('81', lpad(CAST(listing_id AS VARCHAR), 8, '0')) END AS telefono FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return joins.attach_contacts(c.listing, contacts(c)).select("listing_id", "telefono")


@query(
    "e2_lookup_default",
    f"""SELECT listing_id, {rnd('coalesce(e.enc, (SELECT avg(price) FROM listing WHERE listing_id % 2 = 0))', 2)} AS enc
        FROM listing LEFT JOIN (SELECT colonia, recamaras, (avg(price) * count(*) + (SELECT avg(price) FROM listing WHERE listing_id % 2 = 0) * 10) / (count(*) + 10) AS enc
          FROM (SELECT concat(colonia, recamaras) AS colonia, 1 AS recamaras, price FROM listing WHERE listing_id % 2 = 0 AND recamaras < 6) GROUP BY ALL) e
        ON e.colonia = concat(listing.colonia, listing.recamaras)""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.select("listing_id", "price", F.concat("colonia", F.coalesce(F.col("recamaras").cast("string"), F.lit(""))).alias("k"), "recamaras")
    train = rows.filter("listing_id % 2 = 0")
    enc = encode.target_encoder(train.withColumn("k", F.when(F.col("recamaras") < 6, F.col("k"))), "k", "price")
    return encode.map_default(rows, enc, "k", "enc").select("listing_id", half_up("enc", 2).alias("enc"))


_FUZZY = """CASE listing_id % 6 WHEN 0 THEN colonia WHEN 1 THEN lower(colonia) WHEN 2 THEN substr(colonia, 4) WHEN 3 THEN 'zzz'
    WHEN 4 THEN '' ELSE substr(lower(colonia), 6, 3) END"""


@query(
    "e3_resolve_category",
    f""", enc AS (SELECT colonia AS k, (avg(price) * count(*) + (SELECT avg(price) FROM listing) * 10) / (count(*) + 10) AS v FROM listing GROUP BY colonia),
        q AS (SELECT DISTINCT {_FUZZY} AS q FROM listing),
        d AS (SELECT q, min(k) FILTER (WHERE k = q) AS k1, min(k) FILTER (WHERE k = concat(upper(substr(q, 1, 1)), lower(substr(q, 2)))) AS k2,
           min(k) FILTER (WHERE contains(lower(k), lower(q))) AS k3 FROM q CROSS JOIN enc GROUP BY q)
        SELECT listing_id, {rnd('coalesce(enc.v, (SELECT avg(price) FROM listing))', 2)} AS enc
        FROM (SELECT listing_id, {_FUZZY} AS q FROM listing) l JOIN d USING (q) LEFT JOIN enc ON enc.k = coalesce(k1, k2, k3)""",
    "listing",
)
def _(c: Context) -> DataFrame:
    enc = encode.target_encoder(c.listing, "colonia", "price")
    asked = c.listing.select("listing_id", F.expr(_FUZZY).alias("zone"))
    return joins.resolve_category(asked, enc, "zone").select("listing_id", half_up("zone_enc", 2).alias("enc"))


@query(
    "e4_anchor_join",
    f"""SELECT id, model, {rnd('CASE WHEN id % 5 = 0 THEN 25000 ELSE precio_real * 1.1 END', 2)} AS anchor FROM prediction""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    anchors = c.listing.filter("listing_id % 5 <> 0").select(F.col("listing_id").alias("id"), (F.col("price") * 1.1).alias("anchor"))
    got = joins.with_anchor(c.prediction, anchors, fixed.DEFAULT_ANCHOR)
    return got.select("id", "model", half_up("anchor", 2).alias("anchor"))


_ERR = "abs(precio_predicho - precio_real) / precio_real * 100"


@query(
    "e5_align_models",
    f"""SELECT a.id AS id, {rnd('a.e')} AS a, {rnd('b.e')} AS b FROM (SELECT id, {_ERR} AS e FROM prediction WHERE model = 'a') a
        JOIN (SELECT id, {_ERR} AS e FROM prediction WHERE model = 'b') b ON a.id = b.id WHERE a.e IS NOT NULL AND b.e IS NOT NULL""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    preds = c.prediction.withColumn("err", F.expr(_ERR))
    got = joins.align(preds, "a", "b", "err")
    return got.select("id", half_up("a").alias("a"), half_up("b").alias("b"))


@query("e8_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(c: Context) -> DataFrame:
    done = c.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(c.orders, done, "o_orderkey").select("o_orderkey")


@query(
    "e9_answered_by_all",
    "SELECT id FROM prediction WHERE precio_predicho IS NOT NULL GROUP BY id HAVING count(DISTINCT model) = 3",
    "prediction",
)
def _(c: Context) -> DataFrame:
    return joins.answered_by_all(c.prediction, ["a", "b", "c"], "precio_predicho")


@query(
    "e10_backfill",
    "SELECT listing_id, m2, recamaras FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    gaps = c.listing.select("listing_id", F.when(F.col("listing_id") % 2 == 0, F.col("m2")).alias("m2"),
                            F.when(F.col("listing_id") % 3 == 0, F.col("recamaras")).alias("recamaras"))
    return joins.backfill(gaps, c.listing, "listing_id", ["m2", "recamaras"])


@query(
    "e11_expand_grid",
    """SELECT item_id, model, config FROM benchmark CROSS JOIN (VALUES ('m1'), ('m2'), ('m3')) m(model)
       CROSS JOIN (VALUES ('zeroshot'), ('fewshot'), ('fewshot_price')) g(config)""",
)
def _(c: Context) -> DataFrame:
    return joins.expand_grid(c.benchmark.select("item_id"), ["m1", "m2", "m3"], ["zeroshot", "fewshot", "fewshot_price"])


# ---- sorting and set operations -----------------------------------------------------------
def _lead_sort(name: str, order: str, column: str):
    @query(f"h1_sort_{name}", f"SELECT listing_id, CAST(row_number() OVER (ORDER BY {order}, listing_id) AS BIGINT) AS pos FROM listing", "listing")
    def _(c: Context) -> DataFrame:
        return ordering.numbered(c.listing.select("listing_id", "price", "m2", "lujo"), [], [F.expr(column), F.col("listing_id")], "pos").select("listing_id", "pos")


_lead_sort("score", "lujo DESC", "-lujo")
_lead_sort("price_asc", "price", "price")
_lead_sort("price_desc", "price DESC", "-price")
_lead_sort("m2_desc", "coalesce(m2, 0) DESC", "-coalesce(m2, 0.0D)")


@query("h2_nlargest", f"SELECT listing_id, {rnd('price', 2)} AS price FROM listing ORDER BY listing.price DESC, listing_id LIMIT 30", "listing")
def _(c: Context) -> DataFrame:
    return c.listing.orderBy(F.desc("price"), "listing_id").limit(30).select("listing_id", half_up("price", 2).alias("price"))


@query("h3_head_sorted", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def _(c: Context) -> DataFrame:
    return c.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_name")


@query(
    "h4_model_order",
    f"""SELECT model, CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INT) AS pos, {rnd('r2', 6)} AS r2
        FROM (SELECT model, 1 - sum(pow(precio_real - precio_predicho, 2)) / (var_pop(precio_real) * count(*)) AS r2
          FROM prediction WHERE precio_predicho IS NOT NULL GROUP BY model)""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    from valora.operators.evaluate import regression_metrics

    m = regression_metrics(c.prediction, "precio_real", "precio_predicho", ["model"])
    ranked = ordering.numbered(m.select("model", "r2"), [], [-F.col("r2"), F.col("model")], "pos")
    return ranked.select("model", F.col("pos").cast("int").alias("pos"), half_up("r2", 6).alias("r2"))


@query(
    "i1_union_sources",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def _(c: Context) -> DataFrame:
    from valora.streaming.incremental import union_sources

    a = c.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = c.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return union_sources(a, b)


@query(
    "i2_intersection",
    """SELECT id FROM prediction WHERE model = 'a' AND precio_predicho IS NOT NULL INTERSECT SELECT id FROM prediction WHERE model = 'b' AND precio_predicho IS NOT NULL""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    ok = c.prediction.filter("precio_predicho IS NOT NULL")
    return ok.filter("model = 'a'").select("id").intersect(ok.filter("model = 'b'").select("id"))


@query(
    "i3_difference",
    f"""SELECT listing_id FROM ad WHERE regexp_matches(lower(text), '{_SENIOR_RE}') EXCEPT SELECT listing_id FROM ad WHERE regexp_matches(lower(text), '{fixed.KW_STUDENT}')""",
    "ad",
)
def _(c: Context) -> DataFrame:
    a = c.ad.filter(parse.matches("text", _SENIOR_RE)).select("listing_id")
    return a.exceptAll(c.ad.filter(parse.matches("text", fixed.KW_STUDENT)).select("listing_id"))


@query(
    "i4_ordered_distinct",
    """SELECT page_id, string_agg(href, ' ' ORDER BY pos) AS links FROM (SELECT page_id, href, min(pos) AS pos FROM
       (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"', 1) AS h FROM pages))
       GROUP BY page_id, href) GROUP BY page_id""",
)
def _(c: Context) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?is)<a[^>]*href="([^"]*)"'), F.lit(1)))
    return c.pages.filter(F.size(links) > 0).select("page_id", F.array_join(links, " ").alias("links"))


# ---- splits, folds, samples, bootstraps ---------------------------------------------------
@query("j1_split2", f"SELECT listing_id, CASE WHEN {sql_unit('listing_id', 42)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", sampling.split2("listing_id", 42).alias("split"))


@query(
    "j2_split3",
    f"SELECT listing_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'valid' ELSE 'test' END AS split FROM (SELECT listing_id, {sql_unit('listing_id', 7)} AS u FROM listing)",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", sampling.split3("listing_id", 7).alias("split"))


@query("j3_kfold", f"SELECT listing_id, CAST(floor({sql_unit('listing_id', 42)} * 5) AS INT) AS fold FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", sampling.kfold("listing_id", 5, 42).alias("fold"))


@query(
    "j4_repeated_kfold",
    f"SELECT listing_id, CAST(rep AS INT) AS rep, CAST(floor({sql_unit('listing_id', '42 + rep')} * 5) AS INT) AS fold FROM listing, (VALUES (1), (2)) r(rep)",
    "listing",
)
def _(c: Context) -> DataFrame:
    return sampling.repeated_kfold(c.listing.select("listing_id"), "listing_id", 5, 2, 42)


@query("j5_sample_n", f"SELECT listing_id FROM listing ORDER BY {sql_unit('listing_id', 42)}, listing_id LIMIT 700", "listing")
def _(c: Context) -> DataFrame:
    return sampling.sample_n(c.listing.select("listing_id"), "listing_id", 700, 42)


@query("j6_shuffle", f"SELECT listing_id, {sql_unit('listing_id', 42)} AS u FROM listing ORDER BY u, listing_id", "listing")
def _(c: Context) -> DataFrame:
    from valora.functions.numeric import unit_hash

    return sampling.shuffle(c.listing.select("listing_id", unit_hash("listing_id", 42).alias("u")), "listing_id", 42)


def keyed_errors(c: Context) -> DataFrame:
    return c.prediction.withColumn("err", F.expr(_ERR)).withColumn("key", F.concat_ws("|", "id", "model"))


# 10,000 draws of every row are too slow in SQL; the tests compare with the same draws made one by one.
@query("j7_bootstrap_ci")
def _(c: Context) -> DataFrame:
    got = sampling.bootstrap_ci(keyed_errors(c), "key", "err")
    return got.select(half_up("lo").alias("lo"), half_up("hi").alias("hi"), "n")


@query("j8_bootstrap_regression")
def _(c: Context) -> DataFrame:
    got = sampling.bootstrap_regression(keyed_errors(c), "key", "precio_real", "precio_predicho")
    return got.select("metric", half_up("lo").alias("lo"), half_up("hi").alias("hi"))
