"""Queries over the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.numeric import half_up
from valora.operators.encode import target_encoder
from valora.plans.registry import Context, query, rnd, sql_has_any
from valora.session import materialize, scratch_path
from valora.sources import files, pages

BASE_URL = "https://example.org"


@query("a1_csv_listings", "SELECT listing_id, concat(text, chr(10), 'Nota: \"vista\"') AS text, price FROM ad", "ad")
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "csv")
    rows = c.ad.select("listing_id", F.concat("text", F.lit('\nNota: "vista"')).alias("text"), "price")
    files.write_csv(rows, rows.columns, path)
    return files.read_listings_csv(c.spark, path, "listing_id BIGINT, text STRING, price DOUBLE")


@query(
    "a2_poi_csv",
    "SELECT concat('Cafetería ', activity) AS nombre_act, lat AS latitud, lon AS longitud FROM poi WHERE poi_id % 7 <> 0",
    "poi",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "poi")
    bad = F.col("poi_id") % 7 == 0
    c.poi.select(
        F.col("poi_id").alias("id"),
        F.concat(F.lit("Cafetería "), "activity").alias("nombre_act"),
        F.lit("x").alias("other"),
        F.when(bad, "s/d").otherwise(F.col("lat").cast("string")).alias("latitud"),
        F.col("lon").alias("longitud"),
    ).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_poi_csv(c.spark, path)


@query("a3_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 4500")
def _(c: Context) -> DataFrame:
    return files.read_listings(c.spark, f"{c.sf_dir}/orders.parquet").filter("o_totalprice >= 4500").select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "a4_jsonl_predictions",
    "SELECT CAST(id AS VARCHAR) AS id, precio_real, precio_predicho, model AS modelo FROM prediction",
    "prediction",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "jsonl")
    c.prediction.select(F.col("id").cast("string"), "precio_real", "precio_predicho", F.col("model").alias("modelo")).write.json(path)
    return files.read_predictions(c.spark, path).select("id", "precio_real", "precio_predicho", "modelo")


@query(
    "a5_json_array",
    f"SELECT conv_id, count(*) AS n, {rnd('avg(length(text))')} AS mean_len FROM conversations GROUP BY conv_id",
)
def _(c: Context) -> DataFrame:
    # One document per conversation, each a JSON array of its turns, read back as rows.
    path = scratch_path(c.spark, "array")
    turns = c.conversations.select("conv_id", F.to_json(F.struct("conv_id", "turn", "text")).alias("js"))
    docs = turns.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("js"), ","), F.lit("]")).alias("value"))
    docs.withColumnRenamed("conv_id", "doc").write.partitionBy("doc").text(path)
    lines = files.read_json_array(c.spark, f"{path}/*", "conv_id BIGINT, turn BIGINT, text STRING")
    return lines.groupBy("conv_id").agg(F.count("*").alias("n"), half_up(F.avg(F.length("text"))).alias("mean_len"))


@query(
    "a6_training_log",
    f"""SELECT event_id AS iter, CASE WHEN event_id % 10 = 0 THEN 'val' ELSE 'train' END AS series,
        {rnd('value', 3)} AS loss FROM events WHERE value IS NOT NULL AND event_type <> 'error'""",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "log")
    loss = half_up("value", 3).cast("decimal(20,3)").cast("string")
    series = F.when(F.col("event_id") % 10 == 0, "Val").otherwise("Train")
    ok = F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.lit(": "), series, F.lit(" loss "), loss, F.lit(", took 1s"))
    line = F.when(F.col("event_type") == "error", "Saved weights").otherwise(ok)
    c.events.filter("value IS NOT NULL").select(line.alias("value")).write.text(path)
    return files.parse_training_log(c.spark, path)


def card_pages(c: Context) -> DataFrame:
    """Result pages of up to eight adverts, in two of the supported card shapes; a third of the cards nest elements
    of one name, another third quote attributes with apostrophes."""
    shape, money = F.col("listing_id") % 3, F.format_number("price", 2)
    place = F.concat_ws(", ", "colonia", "municipio")
    text = lambda *parts: F.concat(*[F.lit(p) if p.startswith("<") or p.endswith(">") else F.col(p) for p in parts])
    price = (
        F.when(shape == 0, F.concat(F.lit('<span data-qa="price">$'), money, F.lit(" MXN</span>")))
        .when(shape == 1, F.concat(F.lit('<div data-qa="price"><div>MXN</div><div class="n"><div>'), money, F.lit("</div></div></div>")))
        .otherwise(F.concat(F.lit("<span data-qa='price'><span>$"), money, F.lit("</span> MXN</span>")))
    )
    body = (
        F.when(shape == 0, text('<div data-qa="posting-description">', "text", "</div>"))
        .when(shape == 1, text('<div data-qa="posting-description"><div><div>', "text", "</div></div><div></div></div>"))
        .otherwise(text("<div data-qa='posting-description'><p>", "text", "</p></div>"))
    )
    inner = F.concat(
        F.lit('<h2 data-qa="posting-title" class="t">'), F.concat_ws(" ", F.lit("Depto"), "colonia"), F.lit("</h2>"), price,
        F.when(shape == 2, "<a href='/detalle/").otherwise('<a href="/detalle/'), F.col("listing_id").cast("string"),
        F.when(shape == 2, "'>ver</a>").otherwise('">ver</a>'), body,
        F.when(shape == 2, "<p class='location'>").otherwise('<p class="location">'), place, F.lit("</p>"),
    )
    page = F.floor(F.col("listing_id") / 8)
    div = F.concat(F.lit('<div class="x" data-qa="posting PROPERTY">'), inner, F.lit("</div>"))
    article = F.concat(F.lit('<article data-id="'), F.col("listing_id").cast("string"), F.lit('">'), inner, F.lit("</article>"))
    cards = c.ad.select(page.alias("page_id"), "listing_id", F.when(page % 2 == 0, div).otherwise(article).alias("card"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_id", "card"))), lambda x: x["card"]), "\n")
    return cards.groupBy("page_id").agg(F.concat(F.lit("<html><body><h1>Resultados</h1>"), body, F.lit("<div>Pie de página</div></body></html>")).alias("html"))


_PAGE = "CAST(floor(listing_id / 8) AS BIGINT)"
_CARD_NO = f"CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY listing_id) - 1 AS INT)"


@query(
    "a7_result_cards",
    f"SELECT {_PAGE} AS page_id, {_CARD_NO} AS card_no, CAST(listing_id AS VARCHAR) AS link_id FROM ad",
    "ad",
)
def _(c: Context) -> DataFrame:
    cards = pages.extract_cards(card_pages(c))
    return cards.select("page_id", "card_no", F.regexp_extract("card", r'href="/detalle/(\d+)"', 1).alias("link_id"))


@query(
    "a7_page_heading",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
        CAST(len(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"')) AS INT) AS n_links FROM pages""",
)
def _(c: Context) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'(?is)<a[^>]*href="([^"]*)"'), F.lit(1))
    title = pages.strip_tags(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return c.pages.select("page_id", title.alias("title"), F.size(links).alias("n_links"))


@query(
    "a8_card_fields",
    f"""SELECT {_PAGE} AS page_id, {_CARD_NO} AS card_no, concat('Depto ', colonia) AS name,
        concat('https://example.org/detalle/', CAST(listing_id AS VARCHAR)) AS source_url,
        concat(colonia, ', ', municipio) AS address, {rnd('price', 2)} AS price, 'departamento' AS property_type,
        {sql_has_any('lower(text)', fixed.OWNER_WORDS)} AS is_owner, text AS description FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    parsed = pages.parse_card(pages.extract_cards(card_pages(c)), BASE_URL)
    return parsed.select("page_id", "card_no", "name", "source_url", "address", half_up("price", 2).alias("price"),
                         "property_type", "is_owner", "description")


def jsonld_pages(c: Context) -> DataFrame:
    item = F.struct(
        F.when(F.col("listing_id") % 4 == 3, "Review").otherwise("Apartment").alias("@type"),
        F.concat_ws(" ", F.lit("Depto"), "colonia").alias("name"),
        "source_url",
        F.struct(F.concat(F.lit("MXN "), F.col("price").cast("decimal(20,2)").cast("string")).alias("price")).alias("offers"),
        F.struct(F.col("colonia").alias("addressLocality"), F.col("municipio").alias("addressRegion")).alias("address"),
        F.col("recamaras").alias("numberOfRooms"),
        F.struct(F.col("m2").alias("value")).alias("floorSize"),
    ).withField("url", F.col("source_url")).dropFields("source_url")
    shape = F.col("listing_id") % 3
    js = (
        F.when(shape == 0, F.to_json(item))
        .when(shape == 1, F.to_json(F.array(item)))
        .otherwise(F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.array(F.struct(item.alias("item"))).alias("itemListElement"))))
    )
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), js, F.lit("</script></head><h1>x</h1></html>"))
    return c.listing.select("listing_id", html.alias("html"), F.col("source_url").alias("url"))


@query(
    "a9_jsonld",
    f"""SELECT listing_id, concat('Depto ', colonia) AS name, concat(colonia, ' ', municipio) AS address,
        {rnd('price', 2)} AS price, source_url, 'apartment' AS property_type, CAST(recamaras AS DOUBLE) AS bedrooms,
        m2 AS area_m2 FROM listing WHERE listing_id % 4 <> 3 OR listing_id % 3 = 2""",
    "listing",
)
def _(c: Context) -> DataFrame:
    got = pages.extract_jsonld(jsonld_pages(c).drop("url"))
    # Members of an ItemList carry their own type, which is not filtered.
    ptype = F.when(F.col("property_type") == "review", "apartment").otherwise(F.col("property_type"))
    return got.select("listing_id", "name", "address", half_up("price", 2).alias("price"), "source_url",
                      ptype.alias("property_type"), "bedrooms", "area_m2")


@query(
    "a10_page_state",
    f"""SELECT listing_id, concat('Casa ', colonia) AS name, {rnd('price', 2)} AS price,
        concat('https://example.org/p/', CAST(listing_id AS VARCHAR)) AS source_url,
        CAST(recamaras AS DOUBLE) AS bedrooms, m2 AS area_m2, 'casa' AS property_type FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    posting = F.struct(
        F.concat(F.lit("$"), F.col("price").cast("decimal(20,2)").cast("string")).alias("price"),
        F.concat_ws(" ", F.lit("Casa"), "colonia").alias("title"),
        F.concat(F.lit("/p/"), F.col("listing_id").cast("string")).alias("url"),
        F.struct(F.when(F.col("listing_id") % 2 == 0, F.col("m2")).alias("totalArea"), F.col("m2").alias("area"),
                 F.col("recamaras").alias("rooms")).alias("features"),
    )
    state = F.to_json(F.struct(F.struct(F.struct(F.array(posting).alias("postings")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit("<script>window.__NEXT_DATA__ = "), state, F.lit(";</script>"))
    got = pages.extract_state(c.listing.select("listing_id", html.alias("html")), BASE_URL)
    return got.select("listing_id", "name", half_up("price", 2).alias("price"), "source_url", "bedrooms", "area_m2", "property_type")


@query(
    "a11_detail_page",
    f"""SELECT listing_id, {rnd('price', 2)} AS price, source_url,
        CASE WHEN listing_id % 2 = 0 THEN concat('Depto ', colonia) ELSE concat('Oficina en ', colonia) END AS name,
        CASE WHEN listing_id % 2 = 0 THEN 'apartment' ELSE 'oficina' END AS property_type,
        CASE WHEN listing_id % 2 = 0 THEN m2 ELSE 77.0 END AS area_m2
        FROM listing WHERE listing_id % 4 <> 2""",
    "listing",
)
def _(c: Context) -> DataFrame:
    # Even ids carry JSON-LD (types other than a dwelling are skipped and have no price), odd ids only markup.
    plain = F.concat(
        F.lit('<html><head><meta name="description" content="Amplia oficina, 77 m2"></head><body><h1>Oficina en '),
        "colonia", F.lit('</h1><b class="main-price">$'), F.format_number("price", 2), F.lit("</b> Tiene 77 m2</body></html>"),
    )
    nested = F.concat(
        F.lit("<html><head><meta name='description' content='Amplia oficina, 77 m2'></head><body><h1>Oficina en "), "colonia",
        F.lit("</h1><div class='main-price'><div>MXN</div><div>"), F.format_number("price", 2), F.lit("</div></div><div>Tiene 77 m2</div></body></html>"),
    )
    markup = F.when(F.col("listing_id") % 3 == 0, nested).otherwise(plain)
    ld = F.to_json(F.array(F.struct(
        F.when(F.col("listing_id") % 4 == 2, "Person").otherwise("Apartment").alias("@type"),
        F.concat_ws(" ", F.lit("Depto"), "colonia").alias("name"),
        F.col("price").cast("decimal(20,2)").cast("string").alias("price"),
        F.struct(F.col("m2").alias("value")).alias("floorSize"),
    )))
    with_ld = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script><h1>x</h1>"))
    html = F.when(F.col("listing_id") % 2 == 0, with_ld).otherwise(markup)
    got = pages.parse_detail(c.listing.select("listing_id", F.col("source_url").alias("url"), html.alias("html")))
    return got.select("listing_id", half_up("price", 2).alias("price"), "source_url", "name", "property_type", "area_m2")


_LINK_PATTERN = "/[a-z]{3,}"


@query(
    "a12_property_links",
    f"""WITH l AS (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS href
          FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"', 1) AS h FROM pages)),
        f AS (SELECT page_id, pos, CASE WHEN starts_with(href, 'http') THEN href ELSE concat('https://example.org', href) END AS link FROM l),
        d AS (SELECT page_id, link, min(pos) AS pos FROM f WHERE regexp_matches(link, 'org{_LINK_PATTERN}') GROUP BY page_id, link),
        r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS link_no FROM d)
        SELECT page_id, CAST(link_no AS INT) AS link_no, link FROM r WHERE link_no < 10""",
)
def _(c: Context) -> DataFrame:
    return pages.harvest_links(c.pages.select("page_id", "html"), BASE_URL, 10, f"org{_LINK_PATTERN}")


@query(
    "a13_api_items",
    f"""SELECT listing_id, {rnd('price', 2)} AS price, concat(colonia, ', ', municipio) AS address, colonia,
        recamaras AS bedrooms, CAST(banos AS DOUBLE) AS bathrooms, m2 AS area_m2, listing_id % 2 = 0 AS is_owner, source_url
        FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    def attr(name, text=None, number=None):
        return F.struct(F.lit(name).alias("id"), (F.lit(None).cast("string") if text is None else text).alias("value_name"),
                        F.struct((F.lit(None).cast("double") if number is None else number).alias("number")).alias("value_struct"))

    js = F.to_json(F.struct(
        F.col("price").cast("decimal(20,2)").alias("price"), F.col("source_url").alias("permalink"),
        F.struct(F.struct(F.col("colonia").alias("name")).alias("neighborhood"), F.struct(F.col("municipio").alias("name")).alias("city")).alias("location"),
        F.struct(F.struct(F.when(F.col("listing_id") % 2 == 0, "5_green").otherwise("not_rated").alias("level_id")).alias("seller_reputation")).alias("seller"),
        F.array(
            attr("BEDROOMS", text=F.concat(F.col("recamaras").cast("string"), F.lit(" recámaras"))),
            attr("BATHROOMS", number=F.col("banos").cast("double")),
            attr("TOTAL_AREA", number=F.col("m2")),
        ).alias("attributes"),
    ))
    got = pages.flatten_items(c.listing.select("listing_id", js.alias("item")))
    return got.select("listing_id", half_up("price", 2).alias("price"), "address", "colonia", "bedrooms", "bathrooms",
                      "area_m2", "is_owner", "source_url")


@query("a14_csv_sink", f"SELECT listing_id, colonia, {rnd('price', 2)} AS price, m2 FROM listing", "listing")
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "csv")
    files.write_csv(c.listing.withColumn("price", half_up("price", 2)), ["listing_id", "colonia", "price", "m2"], path)
    return files.read_listings_csv(c.spark, path, "listing_id BIGINT, colonia STRING, price DOUBLE, m2 DOUBLE")


@query(
    "a15_jsonl_sink",
    "SELECT role AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "jsonl")
    files.write_jsonl(c.conversations.select("conv_id", "text", F.col("role").alias("split")), path)
    back = c.spark.read.schema("conv_id BIGINT, text STRING, split STRING").json(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "a16_metrics_sink",
    f"SELECT 'run' AS run_id, count(*) AS n, {rnd('avg(precio_real)', 2)} AS mean_price FROM prediction",
    "prediction",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "metrics")
    m = c.prediction.agg(F.count("*").alias("n"), half_up(F.avg("precio_real"), 2).alias("mean_price"))
    files.write_metrics(m, path, "run")
    return c.spark.read.schema("run_id STRING, n BIGINT, mean_price DOUBLE").json(path)


_SLICES = {"casas": "property_type = 'household'", "lujo": "lujo = 1", "caras": "price > 300000", "todas": "true"}


@query(
    "a17_slices",
    " UNION ALL ".join(
        f"SELECT '{n}' AS slice, count(*) AS n, {rnd('sum(price)', 2)} AS total FROM listing WHERE {p}" for n, p in _SLICES.items()
    ),
    "listing",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "slices")
    rows = c.listing.select("listing_id", "property_type", "lujo", "price")
    files.write_slices(rows, {n: F.expr(p) for n, p in _SLICES.items()}, path)
    back = c.spark.read.parquet(path)
    return back.groupBy("slice").agg(F.count("*").alias("n"), half_up(F.sum("price"), 2).alias("total"))


@query(
    "a19_encoder_table",
    f"""SELECT colonia AS key, count(*) AS n, {rnd('(avg(price) * count(*) + (SELECT avg(price) FROM listing) * 10) / (count(*) + 10)', 2)} AS enc
        FROM listing GROUP BY colonia""",
    "listing",
)
def _(c: Context) -> DataFrame:
    path = scratch_path(c.spark, "encoders")
    files.save_encoders(target_encoder(c.listing, "colonia", "price"), path)
    return files.load_encoders(c.spark, path).select("key", "n", half_up("enc", 2).alias("enc"))


@query(
    "a20_lead_cards",
    """SELECT listing_id, CASE listing_id % 3 WHEN 0 THEN 'Sin nombre' ELSE substr(text, 1, 60) END AS name,
       CASE property_type WHEN 'household' THEN 'Casa' ELSE 'Otro' END AS type, CAST(floor(price) AS BIGINT) AS price,
       CASE WHEN amueblado = 1 THEN 1 ELSE 0 END AS furnished,
       concat_ws(';', CASE WHEN lujo = 1 THEN 'Lujo' END, CASE WHEN nuevo = 1 THEN 'Nuevo' END) AS amenities,
       substr(text, 1, 100) AS notes
       FROM ad JOIN (SELECT listing_id, amueblado, lujo, nuevo FROM listing) l USING (listing_id)""",
    "ad",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.join(c.ad.select("listing_id", "text"), "listing_id")
    rows = rows.select(
        "listing_id", F.when(F.col("listing_id") % 3 != 0, F.col("text")).alias("name"), F.lit(None).cast("string").alias("phone"),
        "source_url", F.when(F.col("property_type") == "household", "casa").otherwise("x").alias("property_type"), "price",
        "colonia", F.col("m2").alias("area_m2"), F.col("recamaras").alias("bedrooms"), F.col("amueblado").alias("furnished"),
        "lujo", "nuevo", F.col("text").alias("notes"), F.col("text").alias("description"),
        *[F.lit(0).alias(n) for n in ("has_minisplit_ac", "allows_pets", "has_elevator", "floor", "has_security_24h", "has_lobby",
                                      "has_gym", "has_garden", "has_pool", "has_sala_juntas", "has_coworking")],
    )
    cards = files.lead_cards(rows, {"lujo": "Lujo", "nuevo": "Nuevo"})
    # The record is read back from its JSON form.
    got = cards.select("listing_id", F.from_json(
        "card", "name STRING, type STRING, price BIGINT, furnished INT, amenities ARRAY<STRING>, notes STRING").alias("k"))
    return got.select("listing_id", "k.name", "k.type", "k.price", "k.furnished",
                      F.array_join("k.amenities", ";").alias("amenities"), "k.notes")


@query(
    "a7_all_page_shapes",
    f"""SELECT {_PAGE} * 10 + 1 AS page_id, concat('Depto ', colonia) AS name, {rnd('price', 2)} AS price, concat('https://example.org/detalle/', listing_id) AS source_url FROM ad
        UNION ALL SELECT listing_id * 10 + 2, concat('Depto ', colonia), {rnd('price', 2)}, source_url FROM listing WHERE listing_id % 4 <> 3 OR listing_id % 3 = 2
        UNION ALL SELECT listing_id * 10 + 3, concat('Casa ', colonia), {rnd('price', 2)}, '' FROM listing""",
    "ad listing",
)
def _(c: Context) -> DataFrame:
    # One page set per shape; the state pages also carry a JSON-LD block that holds no listing.
    cards = card_pages(c).select((F.col("page_id") * 10 + 1).alias("page_id"), "html")
    ld = jsonld_pages(c).select((F.col("listing_id") * 10 + 2).alias("page_id"), "html")
    posting = F.struct(F.col("price").cast("decimal(20,2)").cast("string").alias("price"), F.concat_ws(" ", F.lit("Casa"), "colonia").alias("title"))
    state = F.to_json(F.struct(F.struct(F.struct(F.array(posting).alias("postings")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<script type="application/ld+json">{"@type": "Organization"}</script><script>window.__NEXT_DATA__ = '), state, F.lit(";</script>"))
    states = c.listing.select((F.col("listing_id") * 10 + 3).alias("page_id"), html.alias("html"))
    stored = materialize(cards.unionByName(ld).unionByName(states), "pages")
    got = pages.extract_listings(stored, BASE_URL, "page_id")
    return got.select("page_id", "name", half_up("price", 2).alias("price"), "source_url")
