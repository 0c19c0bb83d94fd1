"""Page extraction on hand-written markup."""

from pyspark.sql import functions as F

from valora.sources import pages


def one(spark, html, schema="page_id INT, html STRING"):
    return spark.createDataFrame([(1, html)], schema)


CARD = '<div data-qa="posting PROPERTY"><div data-qa="posting-title">Casa <b>azul</b></div><span class="precio">$ 9,500</span><a href="/p/1">x</a> 3 recámaras</div>'


def test_cards_by_preferred_element(spark):
    html = f"<body>{CARD}{CARD}<article data-id='9' class='listing'>otro</article></body>"
    cards = pages.extract_cards(one(spark, html))
    assert cards.count() == 2
    got = pages.parse_card(cards, "https://x.org").orderBy("card_no").first()
    assert (got.name, got.price, got.source_url, got.bedrooms, got.property_type) == (
        "Casa azul", 9500.0, "https://x.org/p/1", 3, "casa")


def test_fallback_card_elements(spark):
    html = '<article data-id="9"><h3 class="title">Depto</h3><i class="price">$1,000</i></article>'
    got = pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").first()
    assert (got.name, got.price) == ("Depto", 1000.0)
    assert pages.extract_cards(one(spark, "<p>nada</p>")).count() == 0


def test_cards_without_price_are_dropped(spark):
    html = '<article data-id="9"><h3 class="title">Depto</h3></article>'
    assert pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").count() == 0


def test_nested_cards_by_table_function(spark):
    html = '<div data-qa="posting"><div><div data-qa="posting-title"><div>Casa</div> grande</div><br></div><div data-qa="price">$5</div><a href="/1">a</a><a href="/2">b</a></div><div>fuera</div>'
    got = pages.cards_by_udtf(one(spark, html)).collect()
    assert [(r.title, r.price_text, r.link) for r in got] == [("Casa grande", "$5", "/1")]


def test_jsonld_shapes(spark):
    html = """<script type="application/ld+json">{"@type": "House", "name": "A", "offers": {"price": "12000"}}</script>
      <script type="application/ld+json">[{"@type": "Person", "name": "B"}, {"@type": "Product", "name": "C", "price": 7}]</script>
      <script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"item": {"@type": "X", "name": "D", "price": "8"}}, {"name": "E", "price": "9"}]}</script>
      <script type="application/ld+json">not json</script>"""
    got = {r.name: r.price for r in pages.extract_jsonld(one(spark, html)).collect()}
    assert got == {"A": 12000.0, "C": 7.0, "D": 8.0, "E": 9.0}


def test_page_state(spark):
    html = '<script>window.__NEXT_DATA__ = {"props": {"pageProps": {"postings": [{"price": "$5,000", "title": "Casa", "url": "/u", "features": {"area": 80}}, {"price": ""}]}}};</script>'
    got = pages.extract_state(one(spark, html), "https://x.org").collect()
    assert [(r.name, r.price, r.source_url, r.area_m2, r.property_type) for r in got] == [("Casa", 5000.0, "https://x.org/u", 80.0, "casa")]


def test_links_ordered_distinct_and_limited(spark):
    html = "".join(f'<a href="/casa-{i % 12}">x</a>' for i in range(30)) + '<a href="/otro">y</a><a href="https://z.org/propiedad-7">z</a>'
    got = pages.harvest_links(one(spark, html), "https://x.org", 10).orderBy("link_no").collect()
    assert [r.link for r in got] == [f"https://x.org/casa-{i}" for i in range(10)]


def test_first_card_nested_price_and_paragraphs(spark):
    card = ('<div data-qa="posting X"><h2 class="title">Casa <b>azul</b> grande</h2><span data-qa="price"><b>MXN</b> 9,500</span>'
            '<div data-qa="posting-description"><p>Uno.</p><p>Dos.</p></div></div>')
    for html, n in ((card, 1), (card + card, 2), ("<p>x</p>" + card, 1)):
        rows = pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").collect()
        assert [(r.name, r.price, r.description) for r in rows] == [("Casa azul grande", 9500.0, "Uno. Dos.")] * n


def test_single_quoted_cards(spark):
    html = """<article data-id='9'><h3 class='title'>Depto d'Or</h3><i class='price'>$1,000</i></article>"""
    got = pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").first()
    assert (got.name, got.price) == ("Depto d'Or", 1000.0)


def test_elements_of_the_same_name_inside_each_other(spark):
    card = ('<div data-qa="posting"><div class="price"><div>MXN</div><div>9,500</div></div><div class="desc"><div>Uno.<br/><div>Dos.</div></div>Tres.</div>'
            '<DIV class="location"><Div>Centro</DIV></div></div>')
    for html in (card, card + "<div class='desc'>Pie 1,111</div>", f"<div>{card}</div>" * 2, card[:-6]):
        rows = pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").collect()
        assert {(r.price, r.description, r.address) for r in rows} == {(9500.0, "Uno. Dos. Tres.", "Centro")}


def test_a_card_ends_with_its_element(spark):
    html = '<article data-id="9"><i class="price">$1,000</i></article><footer><article>Tel. 81 1234 5678</article>3 recámaras</footer>'
    got = pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").first()
    assert (got.price, got.phone, got.bedrooms) == (1000.0, None, None)


def test_unclosed_and_empty_elements(spark):
    html = '<article data-id="9"><img class="price"><input class="price" value="3"><p class="price">$7,000<p class="desc">Bonito'
    got = pages.parse_card(pages.extract_cards(one(spark, html)), "https://x.org").first()
    assert got.price == 7000.0 and got.description == "Bonito"


def test_single_quoted_pages_through_every_entry(spark):
    html = "<div data-qa='posting X'><div class='price'>$9,500</div><a href='/p/1'>x</a></div>"
    got = pages.extract_listings(one(spark, html), "https://x.org", "page_id").collect()
    assert [(r.price, r.source_url) for r in got] == [(9500.0, "https://x.org/p/1")]
    detail = "<meta name='description' content='Bonita casa'><h1>Casa</h1><div class='price'><div>MXN</div> <div>8,000</div></div>"
    got = pages.parse_detail(spark.createDataFrame([("https://x.org/d", detail)], "url STRING, html STRING")).first()
    assert (got.price, got.description) == (8000.0, "Bonita casa")
    links = pages.harvest_links(one(spark, "<a href='/casa-1'>x</a><a href=\"/casa-2\">y</a>"), "https://x.org", 10).collect()
    assert [r.link for r in links] == ["https://x.org/casa-1", "https://x.org/casa-2"]


def test_texts_of_a_card_are_found_once(spark):
    """The filter on the price stays above the function that finds the texts, and no fold over tags is interpreted."""
    for rows in (pages.parse_card(pages.extract_cards(one(spark, CARD)), "https://x.org"),
                 pages.parse_detail(spark.createDataFrame([(1, CARD, "u")], "page_id INT, html STRING, url STRING"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("texts(") == 1 and "aggregate(" not in plan


def test_end_of_an_element():
    html = "<div>a<DIV/>b<div>c</div><br>d</Div>e</div>"
    assert pages.balanced(html, 5, "div") == "a<DIV/>b<div>c</div><br>d"
    assert pages.balanced("a</p>b", 0, "div") == "a</p>b"


def test_pages_are_read_once(spark):
    """Patterns ran four times over each page, twice over those with JSON-LD."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(html):
        seen.add(1)
        return html

    ld = '<script type="application/ld+json">{"@type": "Apartment", "name": "Depto", "url": "/d/2", "price": "8000"}</script>'
    state = '<script>__NEXT_DATA__ = {"props": {"pageProps": {"postings": [{"price": "7000", "title": "Casa"}]}}};</script>'
    rows = spark.createDataFrame([(1, CARD), (2, ld), (3, state), (4, "<p>'</p>"), (5, None)], "page_id INT, html STRING")
    got = pages.extract_listings(rows.withColumn("html", counted.asNondeterministic()("html")), "https://x.org", "page_id").collect()
    assert sorted((r.page_id, r.price) for r in got) == [(1, 9500.0), (2, 8000.0), (3, 7000.0)]
    assert seen.value == 5
