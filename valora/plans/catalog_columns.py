"""Queries for the column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed, numeric, parse, render, rules
from valora.functions.numeric import half_up
from valora.operators import encode
from valora.plans import jobs
from valora.plans.registry import Context, query, rnd, sql_has_any, sql_list, sql_unit


def num_sql(col: str, pattern: str) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract({col}, '{pattern}', 1), ''), ',', '') AS DOUBLE)"


@query(
    "b1_extract_num",
    f"""SELECT listing_id, {num_sql('text', fixed.NUM_M2)} AS m2, {num_sql('text', fixed.NUM_ROOMS)} AS rooms,
        {num_sql('text', fixed.NUM_BATHS)} AS baths, {num_sql('text', fixed.NUM_PARKING)} AS parking FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    n = parse.extract_num
    return c.ad.select("listing_id", n("text", fixed.NUM_M2).alias("m2"), n("text", fixed.NUM_ROOMS).alias("rooms"),
                       n("text", fixed.NUM_BATHS).alias("baths"), n("text", fixed.NUM_PARKING).alias("parking"))


@query("b2_null_implausible", "SELECT listing_id, CASE WHEN m2 >= 10 THEN m2 END AS m2 FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", numeric.null_if("m2", F.col("m2") < 10).alias("m2"))


@query(
    "b3_price_per_m2",
    f"""SELECT listing_id, {rnd('CASE WHEN m2 IS NOT NULL AND m2 > 0 THEN price / m2 END')} AS a,
        CASE WHEN m2 > 5 THEN {rnd('price / m2', 1)} END AS b FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", half_up(numeric.price_per_m2("price", "m2")).alias("a"),
                            numeric.price_per_m2("price", "m2", 5, 1).alias("b"))


@query(
    "b4_split_location",
    "SELECT listing_id, trim(split_part(location, ',', 1)) AS zone, trim(split_part(location, ',', 2)) AS town FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    zone, town = parse.split_location("location")
    return c.listing.select("listing_id", zone.alias("zone"), town.alias("town"))


_ADDR = """CASE listing_id % 5 WHEN 0 THEN colonia WHEN 1 THEN concat(colonia, ' , ', municipio)
    WHEN 2 THEN concat(municipio, ', Nuevo León') WHEN 3 THEN concat(colonia, ',', municipio, ', Jalisco')
    ELSE concat(colonia, ', a, b, c') END"""


@query(
    "b5_split_address",
    """SELECT listing_id, CASE WHEN listing_id % 5 <> 2 THEN colonia END AS colonia,
       CASE WHEN listing_id % 5 IN (1, 2, 3) THEN municipio END AS municipio,
       CASE listing_id % 5 WHEN 2 THEN 'Nuevo León' WHEN 3 THEN 'Jalisco' END AS estado FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    parts = parse.split_address("address")
    return c.listing.withColumn("address", F.expr(_ADDR)).select("listing_id", *[e.alias(n) for n, e in parts.items()])


@query(
    "b6_split_latlon",
    """SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN lat END AS lat, CASE WHEN listing_id % 3 = 0 THEN lon END AS lon,
       CASE WHEN listing_id % 3 < 2 THEN lat END AS lat2 FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    packed = F.expr("""CASE listing_id % 3 WHEN 0 THEN concat(lat, ' , ', lon) WHEN 1 THEN concat(lat, ',', lon, ',0')
        ELSE 'sin dato' END""")
    lat, lon = parse.split_latlon("packed")
    lat2, _lon2 = parse.split_latlon("packed", strict=False)
    return c.listing.withColumn("packed", packed).select("listing_id", lat.alias("lat"), lon.alias("lon"), lat2.alias("lat2"))


_AFTER = "lower(substr(text, strpos(text, 'Publi')))"


@query(
    "b7_days_listed",
    f"""SELECT listing_id, CASE WHEN regexp_matches({_AFTER}, 'hoy|today') THEN 0
        ELSE TRY_CAST(nullif(regexp_extract({_AFTER}, '(\\d+)', 1), '') AS INT) END AS days FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    return c.ad.select("listing_id", parse.days_listed(F.expr("substr(text, instr(text, 'Publi'))")).alias("days"))


@query(
    "b8_age_days",
    """SELECT listing_id, CAST(coalesce(date_diff('day', CAST(CASE WHEN listing_id % 9 > 0 THEN published END AS DATE), DATE '2000-01-01'), 22) AS INT) AS age
       FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    date = F.when(F.col("listing_id") % 9 > 0, F.col("published"))
    return c.listing.select("listing_id", numeric.age_days(date, "2000-01-01", fixed.DEFAULT_AGE_DAYS).alias("age"))


@query(
    "b9_to_num",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/d' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events""",
)
def _(c: Context) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, "n/d").otherwise(F.get_json_object("props", "$.k"))
    return c.events.select("event_id", numeric.to_num(raw).alias("k"))


@query("b10_clean_url", "SELECT page_id, regexp_replace(trim(url), '^http://', 'https://') AS url FROM pages")
def _(c: Context) -> DataFrame:
    return c.pages.select("page_id", parse.clean_url("url").alias("url"))


@query(
    "b11_abs_url",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat('https://x.org', '/p/', page_id) END AS link FROM pages""",
)
def _(c: Context) -> DataFrame:
    href = F.expr("CASE WHEN page_id % 2 = 0 THEN url ELSE concat('/p/', page_id) END")
    return c.pages.withColumn("href", href).select("page_id", parse.abs_url("https://x.org", "href").alias("link"))


@query(
    "b12_listing_id",
    """SELECT listing_id, CASE WHEN listing_id % 2 = 0 THEN CAST(listing_id AS VARCHAR) END AS ref FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    url = F.expr("CASE WHEN listing_id % 2 = 0 THEN concat(' ', source_url, ' ') ELSE 'http://example.org/otro/1' END")
    return c.listing.select("listing_id", parse.listing_id(url).alias("ref"))


_RAWTYPE = """CASE listing_id % 6 WHEN 0 THEN ' Loft ' WHEN 1 THEN 'TIENDA/LOCAL COMERCIAL' WHEN 2 THEN 'Nave Industrial'
    WHEN 3 THEN NULL WHEN 4 THEN 'Consultorio Médico' ELSE upper(property_type) END"""


@query(
    "b13_canonical_type",
    """SELECT listing_id, CASE listing_id % 6 WHEN 0 THEN 'departamento' WHEN 1 THEN 'local_comercial' WHEN 2 THEN 'bodega_industrial'
       WHEN 3 THEN 'otro' WHEN 4 THEN 'consultorio' ELSE property_type END AS kind FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", parse.canonical_type(F.expr(_RAWTYPE)).alias("kind"))


def type_sql(text: str) -> str:
    whens = " ".join(f"WHEN {sql_has_any(f'lower({text})', words)} THEN '{name}'" for name, words in fixed.TYPE_RULES)
    return f"CASE {whens} ELSE 'otro' END"


@query(
    "b14_classify_type",
    f"SELECT doc_id AS id, {type_sql('text')} AS kind FROM documents UNION ALL SELECT listing_id, {type_sql('text')} FROM ad",
    "ad",
)
def _(c: Context) -> DataFrame:
    both = c.documents.select(F.col("doc_id").alias("id"), "text").unionByName(c.ad.select(F.col("listing_id").alias("id"), "text"))
    return both.select("id", parse.classify_type("text").alias("kind"))


@query("b15_is_owner", f"SELECT listing_id, {sql_has_any('lower(text)', fixed.OWNER_WORDS)} AS owner FROM ad", "ad")
def _(c: Context) -> DataFrame:
    return c.ad.select("listing_id", parse.is_owner("text").alias("owner"))


@query(
    "b16_extract_attrs",
    f"""SELECT listing_id, {num_sql('text', fixed.TEXT_M2)} AS area_m2, CAST({num_sql('text', fixed.TEXT_ROOMS)} AS INT) AS bedrooms,
        {num_sql('text', fixed.TEXT_BATHS)} AS bathrooms, CAST({num_sql('text', fixed.TEXT_PARKING)} AS INT) AS parking FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    return c.ad.select("listing_id", *[e.alias(n) for n, e in parse.extract_attrs("text").items()])


@query(
    "b17_parse_price",
    f"""SELECT listing_id, TRY_CAST(replace(t, ',', '') AS DOUBLE) AS kept, TRY_CAST(replace(replace(t, ',', ''), '.', '') AS DOUBLE) AS digits
        FROM (SELECT listing_id, printf('%.2f', {rnd('price', 2)}) AS t FROM listing)""",
    "listing",
)
def _(c: Context) -> DataFrame:
    text = F.concat(F.lit("MXN $"), F.format_number(half_up("price", 2), 2))
    return c.listing.select("listing_id", parse.parse_price(text).alias("kept"), parse.parse_price(text, keep_dot=False).alias("digits"))


_PHONES = "list_filter(regexp_extract_all(text, '{p}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 13)"


@query(
    "b18_extract_phone",
    f"""SELECT doc_id AS id, trim({_PHONES.format(p=fixed.PHONE)}[1]) AS phone FROM documents
        UNION ALL SELECT -listing_id, trim({_PHONES.format(p=fixed.PHONE)}[1]) FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    docs = c.documents.select(F.col("doc_id").alias("id"), "text")
    ads = c.ad.select((-F.col("listing_id")).alias("id"), "text")
    return docs.unionByName(ads).select("id", parse.extract_phone("text").alias("phone"))


@query(
    "b19_clean_phone",
    """SELECT listing_id, CASE WHEN length(d) >= 10 THEN substr(d, 1, 10) END AS phone, length(d) >= 10 AS valid
       FROM (SELECT listing_id, regexp_replace(substr(text, strpos(text, 'MXN. ')), '[^0-9]', '', 'g') AS d FROM ad)""",
    "ad",
)
def _(c: Context) -> DataFrame:
    tail = F.expr("substr(text, instr(text, 'MXN. '))")
    return c.ad.select("listing_id", parse.clean_phone(tail).alias("phone"), parse.is_valid_phone(tail).alias("valid"))


@query("b20_null_sentinel", "SELECT listing_id, nullif(property_type, 'building') AS kind FROM listing", "listing")
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", parse.null_sentinel("property_type", "building").alias("kind"))


_TAGS = "list_filter([trim(p0), trim(p1), trim(p2), trim(p3)], lambda x: x IS NOT NULL AND lower(x) NOT IN ('', 'nan'))"


def _flag_sql(words) -> str:
    return f"CAST(len(list_filter({_TAGS}, lambda x: " + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + ")) > 0 AS INT)"


@query(
    "b21_tag_flags",
    "SELECT listing_id, " + ", ".join(f"{_flag_sql(w)} AS {n}" for n, w in fixed.TAG_FLAGS.items()) + " FROM pills",
    "pills",
)
def _(c: Context) -> DataFrame:
    tags = c.pills.withColumn("tags", parse.collect_tags(["p0", "p1", "p2", "p3"]))
    return tags.select("listing_id", *[e.alias(n) for n, e in parse.tag_flags("tags").items()])


_WORDS = ["alberca", "terraza", "with", "para", "ción"]


@query(
    "b22_text_flags",
    "SELECT doc_id, " + ", ".join(f"CAST(contains(lower(text), '{w}') AS INT) AS feat_{w}" for w in _WORDS) + " FROM documents",
)
def _(c: Context) -> DataFrame:
    return c.documents.select("doc_id", *[e.alias(n) for n, e in parse.text_flags("text", _WORDS).items()])


@query(
    "b23_text_tags",
    f"SELECT listing_id, array_to_string(list_filter({sql_list(fixed.TEXT_AMENITIES)}, lambda w: contains(lower(text), w)), ';') AS tags FROM ad",
    "ad",
)
def _(c: Context) -> DataFrame:
    return c.ad.select("listing_id", F.array_join(parse.text_tags("text"), ";").alias("tags"))


@query("b24_collect_tags", f"SELECT listing_id, array_to_string({_TAGS}, ';') AS tags FROM pills", "pills")
def _(c: Context) -> DataFrame:
    return c.pills.select("listing_id", F.array_join(parse.collect_tags(["p0", "p1", "p2", "p3"]), ";").alias("tags"))


@query(
    "b25_amenity_count",
    """SELECT listing_id, coalesce(lujo, 0) + coalesce(amueblado, 0) + coalesce(nuevo, 0) AS flags,
       (p0 IS NOT NULL)::INT + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT AS tags
       FROM listing JOIN (SELECT listing_id, p0, p1, p2, p3 FROM pills) USING (listing_id)""",
    "listing pills",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.join(c.pills.select("listing_id", "p0", "p1", "p2", "p3"), "listing_id")
    return rows.select("listing_id", parse.amenity_count(["lujo", "amueblado", "nuevo"]).alias("flags"),
                       parse.amenity_count(["p0", "p1", "p2", "p3"], "tags").alias("tags"))


@query(
    "b26_validate_extraction",
    """SELECT event_id, CASE WHEN k BETWEEN 5 AND 50000 THEN k END AS area_m2,
       CASE WHEN k BETWEEN 0 AND 20 THEN CAST(k AS INT) END AS bedrooms,
       CASE WHEN k / 2 BETWEEN 0.5 AND 20 THEN k / 2 END AS bathrooms,
       CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS furnished, CAST(NULL AS INT) AS has_pool, 250 - 50 AS notes_len
       FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
)
def _(c: Context) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    js = F.to_json(F.struct(
        k.alias("area_m2"), k.alias("bedrooms"), (k / 2).alias("bathrooms"), F.lit("x").alias("parking"),
        F.expr("CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("furnished"),
        F.repeat(F.lit("n"), F.lit(250)).alias("notes"),
    ))
    got = jobs.validate_extraction(c.events.select("event_id", js.alias("js")), "js", ("event_id",))
    return got.select("event_id", "area_m2", "bedrooms", "bathrooms", "furnished", "has_pool", F.length("notes").alias("notes_len"))


@query(
    "b27_unwrap_batch",
    """SELECT conv_id, CAST(pos AS INT) AS pos, CASE WHEN m = 3 AND n > 1 OR m = 2 AND pos = n - 1 OR m = 3 AND n = 1 AND false THEN NULL ELSE pos END AS turn
       FROM (SELECT conv_id, conv_id % 4 AS m, count(*) AS n FROM conversations GROUP BY conv_id) c, LATERAL (SELECT unnest(range(n)) AS pos) t""",
)
def _(c: Context) -> DataFrame:
    # Replies of four shapes per conversation: list, wrapped list, short wrapped list, lone object.
    n = F.count("*").cast("int")
    size = c.conversations.groupBy("conv_id").agg(n.alias("n"))
    items = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("turn")))
    short = F.slice(items, F.lit(1), F.col("n") - 1)
    raw = (
        F.when(F.col("conv_id") % 4 == 0, F.to_json(items))
        .when(F.col("conv_id") % 4 == 1, F.to_json(F.struct(items.alias("results"))))
        .when(F.col("conv_id") % 4 == 2, F.to_json(F.struct(short.alias("data"))))
        .otherwise(F.to_json(F.struct(F.lit(0).alias("turn"))))
    )
    got = jobs.unwrap_batch(size.withColumn("raw", raw), "raw", "n", ("conv_id",))
    return got.select("conv_id", "pos", F.get_json_object("item", "$.turn").cast("bigint").alias("turn"))


@query(
    "b28_log_transform",
    f"SELECT listing_id, {rnd('ln(1 + price)', 6)} AS y, {rnd('exp(ln(1 + price)) - 1', 3)} AS back FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", half_up(numeric.log_t("price"), 6).alias("y"),
                            half_up(numeric.log_inv(numeric.log_t("price")), 3).alias("back"))


@query(
    "b29_boxcox",
    f"""SELECT listing_id, {rnd('(pow(price, 0.358876) - 1) / 0.358876', 5)} AS y, {rnd('ln(price)', 6)} AS y0,
        {rnd('price', 3)} AS back FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    lam = 0.358876
    return c.listing.select("listing_id", half_up(numeric.boxcox("price", lam), 5).alias("y"),
                            half_up(numeric.boxcox("price", 0), 6).alias("y0"),
                            half_up(numeric.inv_boxcox(numeric.boxcox("price", lam), lam), 3).alias("back"))


@query(
    "b30_price_band",
    """SELECT listing_id, CASE WHEN price / 10 < 10000 THEN '' WHEN price / 10 < 20000 THEN 'económico-medio' WHEN price / 10 < 30000 THEN 'medio'
       WHEN price / 10 < 45000 THEN 'medio-alto' ELSE 'alto/lujo' END AS band FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    text = render.price_band(F.col("price") / 10)
    return c.listing.select("listing_id", F.regexp_extract(text, r"\(segmento ([^)]*)\)", 1).alias("band"))


_EDGES, _LABELS = [0, 50_000, 150_000, 300_000, 400_000], ["<50k", "50-150k", "150-300k", "300-400k"]


@query(
    "b31_cut",
    """SELECT id, model, CASE WHEN precio_real > 0 AND precio_real <= 50000 THEN '<50k' WHEN precio_real > 50000 AND precio_real <= 150000 THEN '50-150k'
       WHEN precio_real > 150000 AND precio_real <= 300000 THEN '150-300k' WHEN precio_real > 300000 AND precio_real <= 400000 THEN '300-400k' END AS bin
       FROM prediction""",
    "prediction",
)
def _(c: Context) -> DataFrame:
    return c.prediction.select("id", "model", numeric.cut("precio_real", _EDGES, _LABELS).alias("bin"))


_ZONE = "CASE listing_id % 4 WHEN 0 THEN 'Cumbres 2do sector' WHEN 1 THEN 'Roma Sur' WHEN 2 THEN 'Col. Del Valle y Roma' ELSE colonia END"


@query(
    "b32_zone_tier",
    "SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN 'premium' WHEN 1 THEN 'media' WHEN 2 THEN 'premium' ELSE 'otra' END AS tier FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", rules.zone_tier(F.expr(_ZONE)).alias("tier"))


@query(
    "b33_factor_list",
    """SELECT listing_id, (m2 > 0 AND m2 IS NOT NULL)::INT + (lujo = 1)::INT + coalesce((amueblado = 1)::INT, 0) + (nuevo = 1)::INT + (views > 50)::INT AS n,
       CASE WHEN m2 IS NULL THEN '' WHEN price / m2 > 300 THEN 'alto' WHEN price / m2 > 150 THEN 'razonable' ELSE 'accesible' END AS tier,
       CASE WHEN m2 > 0 THEN regexp_replace(CAST(CAST(floor(price / m2 + 0.5) AS BIGINT) AS VARCHAR), '(\\d)(\\d{3})$', '\\1,\\2') ELSE '' END AS pm2 FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    f = c.listing.withColumn("f", render.factor_list())
    first = F.coalesce(F.get("f", F.lit(0)), F.lit(""))
    return f.select("listing_id", F.size("f").alias("n"), F.regexp_extract(first, r"/mes, (\w+) para", 1).alias("tier"),
                    F.regexp_extract(first, r"\$([\d,]+)/mes", 1).alias("pm2"))


@query("b34_price_range", f"SELECT listing_id, {rnd('price * 0.85', 2)} AS low, {rnd('price * 1.15', 2)} AS high FROM listing", "listing")
def _(c: Context) -> DataFrame:
    got = jobs.price_metrics(c.listing)
    return got.select("listing_id", half_up("low", 2).alias("low"), half_up("high", 2).alias("high"))


_QTAGS = f"array_to_string(list_filter({sql_list(fixed.QUESTION_AMENITIES)}, lambda w: contains(lower(text), w)), ';')"


@query(
    "b35_parse_question",
    f"""SELECT listing_id, trim(nullif(regexp_extract(text, '{fixed.Q_ZONE}', 1), '')) AS zone, {num_sql('text', fixed.Q_M2)} AS m2,
        {num_sql('text', fixed.Q_ROOMS)} AS rooms, {num_sql('text', fixed.Q_BATHS)} AS baths,
        CAST(regexp_matches(text, '{fixed.Q_FURNISHED}') AS INT) AS furnished, {_QTAGS} AS tags FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    got = jobs.parse_questions(c.ad.select("listing_id", "text"))
    return got.select("listing_id", F.col("q_colonia").alias("zone"), F.col("q_m2").alias("m2"), F.col("q_recamaras").alias("rooms"),
                      F.col("q_banos").alias("baths"), F.col("q_amueblado").alias("furnished"), F.array_join("q_amenidades", ";").alias("tags"))


@query(
    "b36_parse_question_words",
    """SELECT listing_id, CASE WHEN listing_id % 2 = 0 THEN 'Del Valle' ELSE 'Roma' END AS zone,
       CAST(CASE listing_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE recamaras END AS DOUBLE) AS rooms, CAST(2 AS DOUBLE) AS parking
       FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    # Questions built from the listings; the lazy zone pattern needs look-ahead, so the SQL states the expected value.
    rooms = F.expr("CASE listing_id % 3 WHEN 0 THEN 'una recámara' WHEN 1 THEN 'Tres recámaras' ELSE coalesce(recamaras || ' recámaras', '') END")
    zone = F.expr("CASE WHEN listing_id % 2 = 0 THEN 'Del Valle, ' ELSE 'Roma con ' END")
    text = F.concat(F.lit("Renta en "), zone, rooms, F.lit(" y dos estacionamientos"))
    got = jobs.parse_questions(c.listing.select("listing_id", text.alias("text")), rich=True)
    return got.select("listing_id", F.col("q_colonia").alias("zone"), F.col("q_recamaras").alias("rooms"),
                      F.col("q_estacionamientos").alias("parking"))


def _price_sql(profile: str) -> str:
    patterns, lo, hi, inclusive = fixed.ANSWER_PROFILES[profile]
    tries = []
    for p in patterns:
        # DuckDB writes the multi-line flag differently.
        p = p.replace("(?im)", "(?im)").replace("'", "''")
        v = num_sql("trim(answer)", p)
        test = f"{v} BETWEEN {lo} AND {hi}" if inclusive else f"{v} > {lo} AND {v} < {hi}"
        tries.append(f"CASE WHEN {test} THEN {v} END")
    return "coalesce(" + ", ".join(tries) + ")"


@query(
    "b37_answer_price",
    "SELECT id, " + ", ".join(f"{_price_sql(p)} AS price_{p}" for p in fixed.ANSWER_PROFILES) + " FROM answer",
    "answer",
)
def _(c: Context) -> DataFrame:
    return jobs.parse_answers(c.answer.select("id", "answer")).drop("answer")


@query(
    "b38_on_topic",
    f"SELECT doc_id AS id, regexp_matches(text, '{fixed.TOPIC}') AS on_topic FROM documents UNION ALL SELECT -listing_id, regexp_matches(text, '{fixed.TOPIC}') FROM ad",
    "ad",
)
def _(c: Context) -> DataFrame:
    both = c.documents.select(F.col("doc_id").alias("id"), "text").unionByName(c.ad.select((-F.col("listing_id")).alias("id"), "text"))
    return both.select("id", parse.is_on_topic("text").alias("on_topic"))


def _n(c: str, unit: str = "", missing: str = "no especificado") -> str:
    return f"coalesce(CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR) || '{unit}', '{missing}')"


def _question_sql() -> str:
    extra = f"array_to_string(list_concat(list_filter([CASE WHEN amueblado = 1 THEN 'Amueblado' END, CASE WHEN lujo = 1 THEN 'Lujo' END, CASE WHEN nuevo = 1 THEN 'Construcción nueva' END], lambda x: x IS NOT NULL), list_slice({_TAGS}, 1, 2)), ', ')"
    picked = f"{sql_list(fixed.QUESTION_TEMPLATES)}[CAST(floor({sql_unit('listing_id', 42)} * 5) AS INT) + 1]"
    values = {
        "tipo": "'propiedad'", "colonia": "colonia", "municipio": "municipio", "rec": _n("recamaras"), "ban": _n("banos"),
        "m2": _n("m2", " m²", "superficie no especificada"), "extras": f"CASE WHEN {extra} <> '' THEN concat({extra}, '. ') ELSE '' END",
    }
    for k, v in values.items():
        picked = f"replace({picked}, '{{{k}}}', {v})"
    return picked


@query(
    "b39_questions",
    f"SELECT listing_id, {_question_sql()} AS pregunta FROM listing JOIN (SELECT listing_id, p0, p1, p2, p3 FROM pills) USING (listing_id)",
    "listing pills",
)
def _(c: Context) -> DataFrame:
    return tagged(c).select("listing_id", render.question_text(42, F.col("tags")).alias("pregunta"))


def tagged(c: Context) -> DataFrame:
    tags = c.pills.select("listing_id", parse.collect_tags(["p0", "p1", "p2", "p3"]).alias("tags"))
    return c.listing.join(tags, "listing_id")


@query(
    "b40_worked_examples",
    f"""SELECT listing_id, {sql_list(fixed.EXAMPLE_QUESTIONS)}[CAST(floor({sql_unit('listing_id', 42)} * 5) AS INT) + 1] AS question,
        coalesce(CAST(recamaras AS VARCHAR), 'No especificado') AS rooms, CASE WHEN m2 > 0 THEN 1 ELSE 0 END + lujo + coalesce(amueblado, 0) + nuevo
          + CASE WHEN len({_TAGS}) > 0 THEN 1 ELSE 0 END + CASE WHEN views > 50 THEN 1 ELSE 0 END AS n_factors,
        coalesce(nullif(array_to_string({_TAGS}, ', '), ''), '') AS tags, 3 AS n_turns
        FROM listing JOIN (SELECT listing_id, p0, p1, p2, p3 FROM pills) USING (listing_id)""",
    "listing pills",
)
def _(c: Context) -> DataFrame:
    got = jobs.render_rows(tagged(c))
    user, answer = F.col("messages")[1]["content"], F.col("messages")[2]["content"]
    return got.select(
        "listing_id", F.element_at(F.split(user, "\n\n"), -1).alias("question"),
        F.regexp_extract(user, r"\*\*Recámaras:\*\* ([^\n]*)", 1).alias("rooms"),
        (F.size(F.split(answer, "\n- ")) - 1).alias("n_factors"),
        F.regexp_extract(user, r"\*\*Amenidades:\*\* ([^\n]*)", 1).alias("tags"), F.size("messages").alias("n_turns"),
    )


@query(
    "b42_render_prompt",
    """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN concat('<|im_start|>system\n', role, '<|im_end|>\n<|im_start|>user\n', text, '<|im_end|>\n<|im_start|>assistant\n')
       WHEN 1 THEN concat('<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n', role, '<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n', text, '<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n')
       WHEN 2 THEN concat('<s>[INST] ', role, '\n\n', text, ' [/INST]')
       ELSE concat('<s><|im_start|>system\n', role, '<|im_end|>\n<|im_start|>user\n', text, '<|im_end|>\n<|im_start|>assistant\n') END AS prompt
       FROM conversations""",
)
def _(c: Context) -> DataFrame:
    family = F.expr("CASE conv_id % 4 WHEN 0 THEN 'chatml' WHEN 1 THEN 'llama3' WHEN 2 THEN 'mistral' ELSE 'chatml_bos' END")
    return c.conversations.select("conv_id", "turn", render.render_prompt("role", "text", family).alias("prompt"))


@query(
    "b43_label",
    "SELECT listing_id, CASE property_type WHEN 'building' THEN 'Edificio' WHEN 'household' THEN 'Hogar' ELSE 'Otro' END AS label FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", parse.label("property_type", {"building": "Edificio", "household": "Hogar"}, "Otro").alias("label"))


@query(
    "b44_truncate",
    r"""SELECT doc_id, substr(flat, 1, 100) AS hard,
        CASE WHEN length(flat) <= 220 THEN flat ELSE concat(coalesce(nullif(regexp_extract(substr(flat, 1, 220), '^(.*) ', 1), ''), substr(flat, 1, 220)), '…') END AS words
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)""",
)
def _(c: Context) -> DataFrame:
    return c.documents.select("doc_id", render.truncate_text("text", 100).alias("hard"), render.truncate_text("text", 220, "word").alias("words"))


@query(
    "b45_format_money",
    r"""SELECT listing_id, CASE WHEN m2 IS NULL THEN '---' ELSE concat('$', regexp_replace(CAST(CAST(m2 * 1000 AS BIGINT) AS VARCHAR), '(\d)(\d{3})$', '\1,\2')) END AS money,
        coalesce(CAST(CAST(floor(m2) AS BIGINT) AS VARCHAR), '---') AS whole FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return c.listing.select("listing_id", render.fmt_money(F.col("m2") * 1000).alias("money"), render.fmt_int("m2").alias("whole"))


@query(
    "b46_tokenize",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+')) AS t FROM documents)
        SELECT doc_id, count(*) AS n, count(DISTINCT t) AS n_distinct, max(t) AS last FROM w WHERE t <> '' GROUP BY doc_id""",
)
def _(c: Context) -> DataFrame:
    return c.documents.select("doc_id", F.explode(parse.tokenize("text")).alias("t")).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("t").alias("n_distinct"), F.max("t").alias("last"))


@query(
    "b47_fill_defaults",
    "SELECT listing_id, coalesce(m2, 85.0) AS m2, coalesce(amueblado, 0) AS amueblado, coalesce(nullif(property_type, 'furniture'), 'Desconocido') AS kind FROM listing",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.select("listing_id", "m2", "amueblado", F.nullif("property_type", F.lit("furniture")).alias("kind"))
    return encode.fill_defaults(rows, {"m2": 85.0, "amueblado": 0, "kind": "Desconocido"})


def hav_sql(a: str, b: str, x: str, y: str) -> str:
    h = f"(pow(sin(radians({x} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({x})) * pow(sin(radians({y} - {b}) / 2), 2))"
    return f"(6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


@query(
    "b48_haversine",
    f"SELECT poi_id, {rnd(hav_sql('lat', 'lon', '25.7', '-100.3'))} AS km FROM poi",
    "poi",
)
def _(c: Context) -> DataFrame:
    return c.poi.select("poi_id", half_up(numeric.haversine("lat", "lon", F.lit(25.7), F.lit(-100.3))).alias("km"))


@query(
    "b49_geo_features",
    f"""SELECT listing_id, {rnd(hav_sql('lat', 'lon', '25.6866', '-100.3161'))} AS dist_center_km, {rnd('abs(lat - 25.65) * 111')} AS dist_avenue_km,
        {rnd('CASE WHEN banos > 0 THEN recamaras / CAST(banos AS DOUBLE) END')} AS rel_floor FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    feats = encode.geo_features()
    return c.listing.select("listing_id", *[half_up(e).alias(n) for n, e in feats.items()],
                            half_up(encode.relative_floor("recamaras", "banos")).alias("rel_floor"))


@query(
    "b50_extract_floor",
    """SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN CAST(listing_id % 30 AS INT) WHEN 1 THEN CAST(listing_id % 20 AS INT) WHEN 2 THEN CAST(listing_id % 9 AS INT) END AS floor FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    text = F.expr("""CASE listing_id % 4 WHEN 0 THEN concat('Depto en PISO ', listing_id % 30) WHEN 1 THEN concat('Nivel ', listing_id % 20, ' vista')
        WHEN 2 THEN concat('en ', listing_id % 9, 'o piso') ELSE 'sin dato' END""")
    return c.listing.select("listing_id", parse.extract_floor(text).alias("floor"))


_CATS = {"small": ["SMALL", "mini"], "metal": ["bolt", "gear", "nut"], "ring": ["ring"], "economy": ["economy"]}


@query(
    "b51_poi_categories",
    "SELECT poi_id, concat_ws(';', " + ", ".join(
        f"CASE WHEN {sql_has_any('lower(activity)', [w.lower() for w in ws])} THEN '{k}' END" for k, ws in _CATS.items()
    ) + ") AS cats FROM poi",
    "poi",
)
def _(c: Context) -> DataFrame:
    return c.poi.select("poi_id", F.array_join(parse.categorise_poi("activity", _CATS), ";").alias("cats"))
