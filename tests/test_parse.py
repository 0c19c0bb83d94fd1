"""Column expressions on hand-typed rows."""

import pytest
from pyspark.sql import functions as F

from valora.functions import numeric, parse, render, rules
from valora.plans import jobs


def values(spark, expr, *rows, schema="t STRING"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


def test_numbers_from_text(spark):
    assert values(spark, parse.extract_num("t", r"(\d+(?:\.\d+)?)\s*m²"), "120.5 m² totales", "sin dato", None) == [120.5, None, None]


def test_addresses(spark):
    rows = ["Cumbres", "Roma, Monterrey", "Monterrey, Nuevo León", "Roma, Monterrey, Jalisco", "a, b, c, d"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, t STRING").orderBy("i").select(
        *[c.alias(n) for n, c in parse.split_address("t").items()]).collect()
    assert [tuple(r) for r in got] == [
        ("Cumbres", None, None), ("Roma", "Monterrey", None), (None, "Monterrey", "Nuevo León"), ("Roma", "Monterrey", "Jalisco"), ("a", None, None)]


@pytest.mark.parametrize("text,strict,lenient", [("25.6, -100.3", 25.6, 25.6), ("25.6,-100.3,1", None, 25.6), ("x", None, None), ("a,b", None, None)])
def test_coordinates(spark, text, strict, lenient):
    assert values(spark, parse.split_latlon("t")[0], text) == [strict]
    assert values(spark, parse.split_latlon("t", strict=False)[0], text) == [lenient]


def test_relative_dates(spark):
    assert values(spark, parse.days_listed("t"), "Publicado HOY", "hace 5 días", "Listed today", "ayer", None) == [0, 5, 0, None, None]


def test_types_and_owner(spark):
    assert values(spark, parse.canonical_type("t"), " Loft ", "Lote/Terreno", "Granja", None) == ["departamento", "terreno", "granja", "otro"]
    assert values(spark, parse.classify_type("t"), "Bonita CASA con local", "Nave en renta", "") == ["casa", "bodega_industrial", "otro"]
    assert values(spark, parse.is_owner("t"), "Inmobiliaria; trato DIRECTO", "agencia", "nada", None) == [True, False, False, False]


def test_attributes(spark):
    df = spark.createDataFrame([("1,250.5 m2 construidos, 3 Recámaras, 2.5 baños, 2 cajones",), ("4 habitaciones 1 baño 1 cochera",)], "t STRING")
    got = [tuple(r) for r in df.coalesce(1).select(*[c.alias(n) for n, c in parse.extract_attrs("t").items()]).collect()]
    assert got == [(1250.5, 3, 2.5, 2), (None, 4, 1.0, 1)]


def test_price_text(spark):
    assert values(spark, parse.parse_price("t"), "MXN $12,000.50", "consultar", None) == [12000.5, None, None]
    assert values(spark, parse.parse_price("t", keep_dot=False), "$12,000.50") == [1200050.0]


def test_phones(spark):
    assert values(spark, parse.extract_phone("t"), "cp 1234-5678, tel 81 2345 6789", "8112345678", "2024-2025", None) == ["81 2345 6789", "8112345678", None, None]
    assert values(spark, parse.clean_phone("t"), "+52 81 1234 5678", "123") == ["5281123456", None]


def test_tags(spark):
    df = spark.createDataFrame([("Gimnasio", "nan", " ", None, "Jardín "), (None, None, None, None, None)], "a STRING, b STRING, c STRING, d STRING, e STRING")
    tags = df.coalesce(1).select(parse.collect_tags(list("abcde")).alias("tags"))
    assert [r.tags for r in tags.collect()] == [["Gimnasio", "Jardín"], []]
    flags = tags.select(*[c.alias(n) for n, c in parse.tag_flags("tags").items()]).collect()
    assert flags[0]["pill_gym"] == 1 and flags[0]["pill_garden"] == 1 and sum(flags[0]) == 2 and sum(flags[1]) == 0


@pytest.mark.parametrize("profile,text,want", [
    ("strict", "$ 12,500", 12500.0), ("strict", "500 MXN o 20000", 20000.0), ("strict", "nada", None),
    ("estimate", "El precio estimado es **$18,000 MXN**, entre $15,000 y $20,000 MXN", 18000.0), ("estimate", "es $1,000 MXN", None),
    ("seed", "estimado es $1,000", 1000.0), ("loose", "$ 200000", 200000.0), ("loose", "$ 200001", None),
    ("anchor", "renta mensual: 14,500", 14500.0),
])
def test_answer_prices(spark, profile, text, want):
    assert values(spark, parse.extract_price("t", profile), text) == [want]


def test_questions(spark):
    df = spark.createDataFrame([("Busco depto amueblado en Del Valle, 85 m², 2 recámaras y 1.5 baños con alberca",)], "text STRING")
    got = jobs.parse_questions(df).first()
    assert (got.q_colonia, got.q_m2, got.q_recamaras, got.q_banos, got.q_amueblado, got.on_topic) == ("Del Valle", 85.0, 2.0, 1.5, 1, True)
    rich = spark.createDataFrame([("¿Cuánto cuesta en Roma con dos recámaras, tres baños y un estacionamiento?",)], "text STRING")
    got = jobs.parse_questions(rich, rich=True).first()
    assert (got.q_colonia, got.q_recamaras, got.q_banos, got.q_estacionamientos) == ("Roma", 2.0, 3.0, 1.0)
    assert values(spark, parse.is_on_topic("t"), "¿Quién ganó el partido?", "Precio de RECÁMARA") == [False, True]


def test_batch_replies(spark):
    rows = [("a", '[{"x":1},{"x":2}]', 3), ("b", '{"items":[{"x":3}]}', 1), ("c", '{"x":4}', 1), ("d", '{"x":5}', 2), ("e", "broken", 1)]
    df = spark.createDataFrame(rows, "k STRING, raw STRING, n INT")
    got = {(r.k, r.pos): r.item for r in jobs.unwrap_batch(df, "raw", "n", ("k",)).collect()}
    assert got == {("a", 0): '{"x":1}', ("a", 1): '{"x":2}', ("a", 2): "{}", ("b", 0): '{"x":3}', ("c", 0): '{"x":4}', ("d", 0): "{}", ("d", 1): "{}", ("e", 0): "{}"}


def test_extraction_record(spark):
    js = '{"area_m2": 4, "bedrooms": "3", "bathrooms": 0.5, "floor": 101, "furnished": false, "has_pool": true, "notes": "' + "n" * 300 + '"}'
    got = jobs.validate_extraction(spark.createDataFrame([(js,)], "js STRING"), "js").first()
    assert (got.area_m2, got.bedrooms, got.bathrooms, got.floor, got.furnished, got.has_pool, got.has_gym, len(got.notes)) == (None, 3, 0.5, None, 0, 1, None, 200)


def test_scores_match_rule_tables():
    assert [rules.max_score(r) for r in rules.PROFILES.values()] == [15, 21, 26]


def test_score_of_missing_values_is_zero(spark):
    cols = {r.column for rs in rules.PROFILES.values() for r in rs}
    kinds = {"property_type": "STRING", "description": "STRING", "colonia": "STRING", "price": "DOUBLE"}
    df = spark.createDataFrame([tuple(None for _ in cols)], ", ".join(f"{c} {kinds.get(c, 'INT')}" for c in cols))
    assert [df.select(rules.score(r)).first()[0] for r in rules.PROFILES.values()] == [0, 0, 0]


def test_zone_tier_prefers_premium(spark):
    assert values(spark, rules.zone_tier("t"), "Roma del Valle", "Mitras Norte", "Centro", None) == ["premium", "media", "otra", None]


def test_text_rendering(spark):
    assert values(spark, render.truncate_text("t", 10, "word"), "uno  dos\ntres cuatro", "corto") == ["uno dos…", "corto"]
    assert values(spark, render.fmt_money("t"), (1234.6,), (None,), schema="t DOUBLE") == ["$1,235", "---"]
    assert values(spark, render.render_prompt(F.lit("S"), F.col("t"), "mistral"), "U") == ["<s>[INST] S\n\nU [/INST]"]


def test_transforms(spark):
    x = (12000.0,)
    lam = 0.358876
    assert values(spark, numeric.inv_boxcox(numeric.boxcox("t", lam), lam), x, schema="t DOUBLE")[0] == pytest.approx(12000)
    assert values(spark, numeric.no_nan("t"), (float("nan"),), (1.0,), schema="t DOUBLE") == [None, 1.0]
    assert values(spark, numeric.cut("t", [0, 10, 20], ["a", "b"]), (0.0,), (10.0,), (20.0,), (21.0,), schema="t DOUBLE") == [None, "a", "b", None]
    assert values(spark, numeric.haversine(F.lit(25.0), F.lit(-100.0), F.col("t"), F.lit(-100.0)), (26.0,), schema="t DOUBLE")[0] == pytest.approx(111.195, abs=1e-3)


def test_poi_categories_overlap(spark):
    assert values(spark, parse.categorise_poi("t"), "Cafeterías, fuentes de sodas, neverías", "Escuelas de educación primaria del sector privado", None) == [
        ["restaurante", "cafe"], ["clinica_priv", "escuela_priv"], []]


def test_floor(spark):
    assert values(spark, parse.extract_floor("t"), "Piso 7", "en nivel 3", "5o piso", "planta baja") == [7, 3, 5, None]


def test_half_a_peso_goes_up_in_reasons(spark):
    df = spark.createDataFrame([("cerca del campus universitario", 12744.5, None, "casa"), ("elevador", 20000.5, 3, "casa")], "t STRING, price DOUBLE, rooms INT, kind STRING")
    flags = rules.segment_flags("t", "price", "rooms", "kind")
    got = df.select("*", *[c.alias(n) for n, c in flags.items()]).coalesce(1).select(rules.segment_reason("price", "rooms")).collect()
    assert [r[0] for r in got] == ["precio $12,745 | keyword universitario", "accesibilidad | precio $20,001"]


def test_half_a_peso_goes_up_in_comparables(spark):
    df = spark.createDataFrame([(1, 1000.5), (2, 12744.5), (3, 12745.5), (4, 999.4999)], "r INT, price DOUBLE")
    for n in ("m2", "recamaras", "amueblado", "lujo"):
        df = df.withColumn(n, F.lit(None).cast("int"))
    got = df.withColumn("colonia", F.lit("Roma")).orderBy("r").select(render.comparable_line(F.col("r"), F.col("price"))).collect()
    assert [r[0].split(" → ")[1] for r in got] == ["$1,001 MXN/mes", "$12,745 MXN/mes", "$12,746 MXN/mes", "$999 MXN/mes"]
