"""Listings out of web pages: result cards, JSON-LD blocks, embedded page state, detail pages, links."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.numeric import col
from valora.functions.parse import (
    abs_url, capture, classify_type, extract_attrs, extract_phone, is_owner, parse_price,
)
from valora.session import materialize

# --- fixed values: start tags of a result card, in order of preference ---------------------
CARD_STARTS = [
    r'<div[^>]*data-qa="posting(?: [^"]*)?"',
    r"<div[^>]*data-postingid=",
    r'<div[^>]*data-id=[^>]*class="[^"]*(?:posting|property|listing)',
    r"<article[^>]*data-id=",
    r'<article[^>]*class="[^"]*(?:posting|property|listing|inmueble)',
    r'<section[^>]*data-qa="[^"]*posting',
]
_CARD_KINDS = [re.compile(start, re.ASCII | re.IGNORECASE) for start in CARD_STARTS]
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"  # elements without content
JSONLD_SCRIPT = r"""(?is)<script[^>]*type=["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
STATE_SCRIPT = r"(?s)__NEXT_DATA__\s*=\s*(\{.*?\});"

_ADDRESS = "STRUCT<streetAddress: STRING, addressLocality: STRING, addressRegion: STRING>"
_ITEM = (
    "`@type`: STRING, name: STRING, url: STRING, description: STRING, price: STRING, "
    f"offers: STRUCT<price: STRING>, address: {_ADDRESS}, numberOfRooms: DOUBLE, "
    "numberOfBathroomsTotal: DOUBLE, floorSize: STRUCT<value: DOUBLE>"
)
JSONLD_ITEM = f"STRUCT<{_ITEM}, itemListElement: ARRAY<STRUCT<item: STRUCT<{_ITEM}>, {_ITEM}>>>"
STATE_ITEM = (
    "STRUCT<price: STRING, priceTotal: STRING, title: STRING, url: STRING, permalink: STRING, address: STRING, "
    "description: STRING, features: STRUCT<totalArea: DOUBLE, area: DOUBLE, rooms: DOUBLE, bathrooms: DOUBLE, "
    "garages: DOUBLE>>"
)


def strip_tags(c: str | Column) -> Column:
    plain = F.regexp_replace(col(c), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)([^<>]*+(?:<(?!/?[A-Za-z])[^<>]*+)*+>)?", re.ASCII)
_FLAGS = re.ASCII | re.IGNORECASE | re.DOTALL  # as (?is) in Java


def balanced(html: str, start: int, name: str) -> str:
    """``html`` from ``start`` up to the tag that closes an element ``name`` opened before it; all of it where none does.

    A running depth goes up at each start tag of that name and down at each end tag; elements closed in
    their own tag leave it.
    """
    depth = 1
    for tag in _TAG.finditer(html, start):
        if tag[2].lower() == name and not (tag[3] or "").endswith("/>"):
            depth += -1 if tag[1] else 1
            if not depth:
                return html[start:tag.start()]
    return html[start:]


def _plain(text: str) -> str:
    """:func:`strip_tags` of one string."""
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", text), flags=re.ASCII).strip(" ")


def inner_texts(c: str | Column, **starts: Sequence[str]) -> Column:
    """A struct of texts: for each name that of the first element whose start tag matches, up to the tag that closes
    it, of the first pattern that finds any text; elements without content are passed over.

    The column is computed once: a filter on it is not moved below it (its function is marked nondeterministic for this).
    """
    tries = {n: [re.compile(rf"<(?!(?:{VOID})\b)([a-z][\w-]*)[^>]*{p}[^>]*>", _FLAGS) for p in ps] for n, ps in starts.items()}

    def first_text(html: str | None, patterns: list[re.Pattern]) -> str | None:
        for pattern in patterns if html else ():
            if (tag := pattern.search(html)) and (text := _plain(balanced(html, tag.end(), tag[1].lower()))):
                return text
        return None

    @F.pandas_udf(", ".join(f"{n} STRING" for n in tries))
    def texts(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: [first_text(h, ps) for h in html] for n, ps in tries.items()}, dtype=object)

    return texts.asNondeterministic()(col(c))


def double_quoted(html: str | Column) -> Column:
    """Attributes in single quotes, inside tags, put in double quotes; nothing else changes."""
    replaced = F.regexp_replace(col(html), r"(?<=[\w-])\s*=\s*'([^'\"<>]*)'(?=[^<>]*>)", '="$1"')
    return F.when(col(html).contains("'"), replaced).otherwise(col(html))


def _cards(html: str | None) -> list[str] | None:
    """The card elements of a page, without their end tags, of the first kind that occurs."""
    for kind in _CARD_KINDS if html else ():
        starts, at = [], 0
        while found := kind.search(html, at):
            starts.append(found.start())
            at = found.start() + 1
        if starts:
            return [_element(html[lo:hi]) for lo, hi in pairwise([*starts, len(html)])]
    return None


def _element(piece: str) -> str:
    """The element that ``piece`` begins with, without its end tag."""
    tag = re.match(r"<[^>]*>", piece)
    if not tag:
        return piece
    return tag[0] + balanced(piece, tag.end(), _TAG.match(piece)[2].lower())


def extract_cards(pages: DataFrame, html: str = "html", quoted: bool = False) -> DataFrame:
    """One row per card: the first kind of card element that occurs on the page decides. A card ends
    where its element is closed, or where the next one begins. ``quoted`` pages have been through :func:`double_quoted`."""
    @F.pandas_udf("array<string>")
    def cards(column: pd.Series) -> pd.Series:
        return pd.Series([_cards(h) for h in column], dtype=object)

    found = pages.withColumn("__cards", cards.asNondeterministic()(col(html) if quoted else double_quoted(html)))
    return found.select(
        *[c for c in pages.columns if c != html], F.posexplode("__cards").alias("card_no", "card")
    )


def parse_card(cards: DataFrame, base_url: str, card: str = "card") -> DataFrame:
    """Typed fields of each card; a card without a price is dropped."""
    texts = inner_texts(
        card,
        price=[r'data-qa="price"', r'class="[^"]*(?:price|precio)[^"]*"'],
        title=['data-qa="posting-title"'],
        description=['data-qa="posting-description"', r'class="[^"]*(?:desc|body|detail|summary)[^"]*"'],
        address=[
            'data-qa="posting-location"', r'data-qa="[^"]*(?:location|address)[^"]*"',
            r'class="[^"]*(?:location|address|colonia|zona|lugar)[^"]*"',
        ],
    )
    cards = cards.withColumns({"__full": strip_tags(card), "__texts": texts})
    title = F.coalesce(
        F.col("__texts.title"),
        F.nullif(
            strip_tags(capture(card, r'(?is)<h[234][^>]*class="[^"]*(?:title|name|heading)[^"]*"[^>]*>(.*?)</h')),
            F.lit(""),
        ),
        F.lit(""),
    )
    description = F.coalesce(F.col("__texts.description"), F.substring("__full", 1, 300))
    staged = cards.withColumn("name", title).withColumn("description", description)
    out = staged.select(
        *[c for c in cards.columns if c not in (card, "__full", "__texts")],
        "name",
        "description",
        F.coalesce("__texts.address", F.lit("")).alias("address"),
        parse_price("__texts.price").alias("price"),
        abs_url(base_url, capture(card, r'(?is)<a[^>]*href="([^"]*)"')).alias("source_url"),
        classify_type(F.concat_ws(" ", "name", "description")).alias("property_type"),
        is_owner("__full").alias("is_owner"),
        extract_phone("__full").alias("phone"),
        *[c.alias(n) for n, c in extract_attrs("__full").items()],
    )
    return out.filter(F.col("price") > 0)


def _jsonld_fields(item: str) -> list[Column]:
    addr = F.trim(
        F.concat_ws(
            " ",
            *[F.coalesce(F.col(f"{item}.address.{p}"), F.lit(""))
              for p in ("streetAddress", "addressLocality", "addressRegion")],
        )
    )
    raw = F.when(F.col(f"{item}.offers").isNotNull(), F.col(f"{item}.offers.price")).otherwise(F.col(f"{item}.price"))
    return [
        F.coalesce(F.col(f"{item}.name"), F.lit("")).alias("name"),
        F.coalesce(F.col(f"{item}.description"), F.lit("")).alias("description"),
        addr.alias("address"),
        parse_price(raw).alias("price"),
        F.coalesce(F.col(f"{item}.url"), F.lit("")).alias("source_url"),
        F.lower(F.col(f"{item}.`@type`")).alias("property_type"),
        F.col(f"{item}.numberOfRooms").alias("bedrooms"),
        F.col(f"{item}.numberOfBathroomsTotal").alias("bathrooms"),
        F.col(f"{item}.floorSize.value").alias("area_m2"),
    ]


def extract_jsonld(pages: DataFrame, html: str = "html", types: list[str] | None = None) -> DataFrame:
    """Listings of the JSON-LD blocks: a single object, a list of objects, or an ItemList."""
    types = types or fixed.JSONLD_TYPES
    keep = [c for c in pages.columns if c != html]
    blocks = pages.select(*keep, F.explode(F.regexp_extract_all(F.col(html), F.lit(JSONLD_SCRIPT), F.lit(1))).alias("js"))
    js = F.trim("js")
    objects = F.when(js.startswith("["), F.from_json(js, f"ARRAY<{JSONLD_ITEM}>")).otherwise(
        F.array(F.from_json(js, JSONLD_ITEM))
    )
    top = blocks.select(*keep, F.explode(objects).alias("o"))
    plain = [F.col(f"o.{n}").alias(n) for n in ("name", "url", "description", "price", "offers", "address",
                                               "numberOfRooms", "numberOfBathroomsTotal", "floorSize")]
    single = F.array(F.struct(F.col("o.`@type`").alias("@type"), *plain))
    members = F.transform(
        "o.itemListElement",
        lambda e: F.coalesce(
            e["item"],
            F.struct(e["@type"].alias("@type"), *[e[n].alias(n) for n in (
                "name", "url", "description", "price", "offers", "address", "numberOfRooms",
                "numberOfBathroomsTotal", "floorSize")]),
        ),
    )
    kind = F.col("o.`@type`")
    items = top.select(*keep, F.explode(F.when(kind.isin(types), single).when(kind == "ItemList", members)).alias("i"))
    return items.select(*keep, *_jsonld_fields("i")).filter(F.col("price") > 0)


def extract_state(pages: DataFrame, base_url: str, html: str = "html", path: str = "$.props.pageProps.postings") -> DataFrame:
    """Listings of the page state embedded as JSON in a script."""
    keep = [c for c in pages.columns if c != html]
    postings = F.from_json(F.get_json_object(capture(html, STATE_SCRIPT), path), f"ARRAY<{STATE_ITEM}>")
    items = pages.select(*keep, F.explode(postings).alias("p"))
    nz = lambda c: F.nullif(F.col(c), F.lit(0.0))  # noqa: E731 - zero counts as missing
    url = F.coalesce(F.nullif(F.col("p.url"), F.lit("")), F.col("p.permalink"), F.lit(""))
    out = items.select(
        *keep,
        F.coalesce(F.col("p.title"), F.lit("")).alias("name"),
        F.coalesce(F.col("p.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("p.address"), F.lit("")).alias("address"),
        parse_price(F.coalesce(F.nullif(F.col("p.price"), F.lit("")), F.col("p.priceTotal"))).alias("price"),
        F.when(url == "", "").otherwise(abs_url(base_url, url)).alias("source_url"),
        nz("p.features.rooms").alias("bedrooms"),
        nz("p.features.bathrooms").alias("bathrooms"),
        nz("p.features.garages").alias("parking"),
        F.coalesce(nz("p.features.totalArea"), nz("p.features.area")).alias("area_m2"),
    )
    return out.withColumn("property_type", classify_type(F.concat_ws(" ", "name", "description"))).filter(
        F.col("price") > 0
    )


def parse_detail(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One listing per detail page: its JSON-LD if it has one, else heading, price and description."""
    pages = pages.withColumn(html, double_quoted(html))
    h1 = F.coalesce(strip_tags(capture(html, r"(?is)<h1[^>]*>(.*?)</h1>")), F.lit(""))
    price = parse_price("__texts.price")
    meta = F.coalesce(capture(html, r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"'), F.lit(""))
    js = F.trim(capture(html, JSONLD_SCRIPT))
    objects = F.when(js.startswith("["), F.from_json(js, f"ARRAY<{JSONLD_ITEM}>")).otherwise(
        F.array(F.from_json(js, JSONLD_ITEM))
    )
    good = F.filter(objects, lambda o: o["@type"].isin(fixed.DETAIL_TYPES))
    body = strip_tags(F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " "))
    texts = inner_texts(html, price=[r'class="[^"]*(?:price|precio)[^"]*"'])
    staged = pages.withColumns({"ld": F.get(good, F.lit(0)), "__body": body, "__texts": texts})
    ld_price = parse_price(F.coalesce(F.col("ld.offers.price"), F.col("ld.price")))
    use_ld = F.coalesce(ld_price > 0, F.lit(False))
    attrs = extract_attrs("__body")
    out = staged.select(
        *[c for c in pages.columns if c not in (html, url)],
        F.col(url).alias("source_url"),
        F.when(use_ld, F.coalesce(F.col("ld.name"), F.lit(""))).otherwise(h1).alias("name"),
        F.when(use_ld, F.coalesce(F.col("ld.description"), F.lit(""))).otherwise(meta).alias("description"),
        F.when(use_ld, ld_price).otherwise(price).alias("price"),
        F.when(use_ld, F.lower(F.col("ld.`@type`")))
        .otherwise(classify_type(F.concat_ws(" ", h1, meta))).alias("property_type"),
        F.when(use_ld, F.col("ld.numberOfRooms")).otherwise(attrs["bedrooms"].cast("double")).alias("bedrooms"),
        F.when(use_ld, F.col("ld.floorSize.value")).otherwise(attrs["area_m2"]).alias("area_m2"),
    )
    return out.filter(F.col("price") > 0)


def harvest_links(
    pages: DataFrame, base_url: str, k: int = 10, pattern: str = fixed.PROPERTY_LINK, html: str = "html"
) -> DataFrame:
    """Distinct absolute links that match the pattern, the first ``k`` of each page in page order."""
    hrefs = F.regexp_extract_all(double_quoted(html), F.lit(r'(?is)<a[^>]*href="([^"]*)"'), F.lit(1))
    full = F.transform(hrefs, lambda h: abs_url(base_url, h))
    wanted = F.array_distinct(F.filter(full, lambda u: u.rlike(pattern)))
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.posexplode(F.slice(wanted, 1, k)).alias("link_no", "link"),
    )


def flatten_items(items: DataFrame, js: str = "item") -> DataFrame:
    """Nested API items to typed columns; attributes arrive as a list of id/value pairs."""
    schema = (
        "STRUCT<price: DOUBLE, title: STRING, permalink: STRING, description: STRING, "
        "location: STRUCT<neighborhood: STRUCT<name: STRING>, city: STRUCT<name: STRING>>, "
        "seller: STRUCT<seller_reputation: STRUCT<level_id: STRING>>, "
        "attributes: ARRAY<STRUCT<id: STRING, value_name: STRING, value_struct: STRUCT<number: DOUBLE>>>>"
    )
    parsed = items.withColumn("i", F.from_json(js, schema))
    def attr(name: str) -> Column:
        """Value of the last attribute with this id; zero counts as missing."""
        last = F.try_element_at(F.filter("i.attributes", lambda a: a["id"] == name), F.lit(-1))
        return F.nullif(F.coalesce(last["value_struct"]["number"], parse_price(last["value_name"])), F.lit(0.0))

    place = F.concat_ws(
        ", ", F.nullif(F.col("i.location.neighborhood.name"), F.lit("")), F.nullif(F.col("i.location.city.name"), F.lit(""))
    )
    return parsed.select(
        *[c for c in items.columns if c != js],
        F.coalesce(F.col("i.title"), F.lit("")).alias("name"),
        place.alias("address"),
        F.nullif(F.col("i.location.neighborhood.name"), F.lit("")).alias("colonia"),
        F.nullif(F.col("i.price"), F.lit(0.0)).alias("price"),
        attr("BEDROOMS").cast("int").alias("bedrooms"),
        F.coalesce(attr("FULL_BATHROOMS"), attr("BATHROOMS")).alias("bathrooms"),
        attr("PARKING_LOTS").cast("int").alias("parking"),
        F.coalesce(attr("COVERED_AREA"), attr("TOTAL_AREA")).alias("area_m2"),
        (~F.coalesce(F.col("i.seller.seller_reputation.level_id"), F.lit("")).contains("not_")).alias("is_owner"),
        F.coalesce(F.col("i.permalink"), F.lit("")).alias("source_url"),
    )


class _CardParser(HTMLParser):
    """Collects title, price text and first link of card elements, minding nesting."""

    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__()
        self.depth, self.card_depth, self.field, self.field_depth = 0, None, None, 0
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.depth += 1
        a = dict(attrs)
        qa = (a.get("data-qa") or "").lower()
        if self.card_depth is None and (qa.split(" ")[0] == "posting" or (tag == "article" and "data-id" in a)):
            self.card_depth = self.depth
            self.cards.append({"title": "", "price": "", "link": None})
        elif self.card_depth is not None:
            if qa in ("posting-title", "price"):
                self.field, self.field_depth = qa.removeprefix("posting-"), self.depth
            if tag == "a" and a.get("href") and self.cards[-1]["link"] is None:
                self.cards[-1]["link"] = a["href"]

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        if self.field and self.depth == self.field_depth:
            self.field = None
        if self.card_depth == self.depth:
            self.card_depth = None
        self.depth -= 1

    def handle_data(self, data):
        if self.field:
            self.cards[-1][self.field] += data


@F.udtf(returnType="card_no INT, title STRING, price_text STRING, link STRING", useArrow=True)
class CardsUDTF:
    """Table function for pages whose nesting defeats patterns: html -> one row per card."""

    def eval(self, html: str):
        if html is None:
            return
        parser = _CardParser()
        parser.feed(html)
        for i, card in enumerate(parser.cards):
            yield i, card["title"].strip(), card["price"].strip(), card["link"]


def cards_by_udtf(pages: DataFrame, html: str = "html") -> DataFrame:
    spark = pages.sparkSession
    spark.udtf.register("valora_cards", CardsUDTF)
    keep = ", ".join(f"p.{c}" for c in pages.columns if c != html)
    return spark.sql(f"SELECT {keep}, c.* FROM {{pages}} p, LATERAL valora_cards(p.{html}) c", pages=pages)


def extract_listings(pages: DataFrame, base_url: str, key: str, html: str = "html") -> DataFrame:
    """Listings of result pages: from cards; from JSON-LD where a page has no cards; from the page
    state where it has neither."""
    fields = [key, "name", "description", "address", "price", "source_url", "property_type", "bedrooms", "area_m2"]

    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumn("bedrooms", F.col("bedrooms").cast("double")).select(*fields)

    # Patterns run once over a page: what follows reads its pages from the stored table, and JSON-LD rows are stored too.
    has_cards = F.coalesce(F.col(html).rlike("(?i)" + "|".join(CARD_STARTS)), F.lit(False)).alias("__cards_in")
    rows = materialize(pages.select(key, double_quoted(html).alias(html)).select(key, html, has_cards), "quoted")
    from_cards = shaped(parse_card(extract_cards(rows.filter("__cards_in").select(key, html), html, quoted=True), base_url))
    plain = rows.filter("NOT __cards_in").select(key, html)
    from_ld = materialize(shaped(extract_jsonld(plain, html)), "json-ld")
    rest = plain.join(from_ld.select(key).distinct(), key, "left_anti")
    return from_cards.unionByName(from_ld).unionByName(shaped(extract_state(rest, base_url, html)))
