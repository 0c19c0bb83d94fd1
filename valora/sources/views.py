"""Listing-domain views over the test tables, as SQL text that Spark and DuckDB both run.

A placeholder such as ``{orders}`` is a table name: Spark binds a DataFrame to it, the oracle the
bare name. Each view may use the views before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_LISTING = """
SELECT o.o_orderkey AS listing_id, o.o_totalprice AS price,
       n.n_name AS colonia, r.r_name AS municipio,
       concat(n.n_name, ', ', r.r_name) AS location,
       li.m2 AS m2, CAST(li.n_lines AS INT) AS recamaras, CAST(li.n_supp AS INT) AS banos,
       lower(c.c_mktsegment) AS property_type,
       CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS lujo,
       CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS amueblado,
       CASE WHEN year(o.o_orderdate) >= 1998 THEN 1 ELSE 0 END AS nuevo,
       o.o_orderdate AS published, c.c_acctbal AS views,
       concat('http://example.org/detalle/', CAST(o.o_orderkey AS STRING)) AS source_url,
       CAST(25.6 AS DOUBLE) + CAST(o.o_orderkey * 37 % 1000 AS DOUBLE) / 4000 AS lat,
       CAST(-100.4 AS DOUBLE) + CAST(o.o_orderkey * 91 % 1000 AS DOUBLE) / 4000 AS lon
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (
  SELECT l_orderkey, SUM(l_quantity) AS m2, COUNT(*) AS n_lines, COUNT(DISTINCT l_suppkey) AS n_supp
  FROM {lineitem} GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
"""

_POI = """
SELECT p_partkey AS poi_id, concat(p_type, ' ', p_name) AS activity,
       CAST(25.6 AS DOUBLE) + CAST(p_partkey * 53 % 997 AS DOUBLE) / 4000 AS lat,
       CAST(-100.4 AS DOUBLE) + CAST(p_partkey * 71 % 991 AS DOUBLE) / 4000 AS lon
FROM {part}
"""

_PREDICTION = """
SELECT o.o_orderkey AS id, m.model AS model, o.o_totalprice AS precio_real,
       CASE WHEN (o.o_orderkey * 7 + m.k) % 11 = 0 THEN NULL
            ELSE o.o_totalprice * (CAST(60 + (o.o_orderkey * m.k * 13) % 81 AS DOUBLE) / 100) END AS precio_predicho,
       CASE WHEN o.o_orderkey % 10 < 8 THEN 'train' WHEN o.o_orderkey % 10 = 8 THEN 'valid' ELSE 'test' END AS split
FROM (SELECT o_orderkey, o_totalprice, {models} AS ms FROM {orders}) o {unnest_models}
"""

# One advert text per listing, in the language the text rules are written for.
_AD = """
SELECT listing_id, colonia, municipio, price, m2, recamaras, banos, views, property_type, published,
  concat(
    CASE listing_id % 8 WHEN 0 THEN 'Departamento' WHEN 1 THEN 'CASA' WHEN 2 THEN 'Oficina'
      WHEN 3 THEN 'Local comercial' WHEN 4 THEN 'Bodega' WHEN 5 THEN 'Terreno' WHEN 6 THEN 'Estudio'
      ELSE 'Propiedad' END,
    ' en ', colonia, ', ', municipio, '. ',
    coalesce(CAST(recamaras AS STRING) || CASE WHEN listing_id % 3 = 0 THEN ' recámaras, ' ELSE ' habitaciones, ' END, ''),
    coalesce(CAST(banos AS STRING) || CASE WHEN listing_id % 2 = 0 THEN '.5' ELSE '' END || ' baños, ', ''),
    coalesce(CASE WHEN listing_id % 4 = 0 THEN '1,' ELSE '' END || CAST(CAST(m2 AS INT) + 100 AS STRING) || ' m² construidos. ', ''),
    CASE WHEN listing_id % 6 = 0 THEN '2 cajones de estacionamiento. ' WHEN listing_id % 6 = 1 THEN '1 cochera. ' ELSE '' END,
    CASE listing_id % 7 WHEN 0 THEN 'A pasos del campus, ideal estudiante. '
      WHEN 1 THEN 'Con elevador y seguridad 24 horas. ' WHEN 2 THEN 'Zona tranquila en planta baja. '
      WHEN 3 THEN 'Alberca, gimnasio y terraza. ' WHEN 4 THEN 'Amueblado, listo para roomie. '
      WHEN 5 THEN 'Jardín y guardia; universitarios bienvenidos. ' ELSE '' END,
    CASE listing_id % 5 WHEN 0 THEN 'Trato directo con dueño. ' WHEN 1 THEN 'Inmobiliaria Realty. '
      WHEN 2 THEN 'Particular renta, no agencia. ' ELSE '' END,
    'Precio $', CAST(CAST(floor(price / 1000) AS INT) AS STRING), ',',
      lpad(CAST(CAST(floor(price) AS INT) % 1000 AS STRING), 3, '0'), ' MXN. ',
    CASE listing_id % 9 WHEN 0 THEN 'Tel. 81 2345 ' WHEN 1 THEN 'Llame 8112' WHEN 2 THEN 'WhatsApp 811-234-' ELSE 'Sin teléfono ' END,
      lpad(CAST(listing_id % 10000 AS STRING), CASE WHEN listing_id % 9 = 1 THEN 6 ELSE 4 END, '1'), '. ',
    CASE listing_id % 4 WHEN 0 THEN 'Publicado HOY' WHEN 1 THEN concat('Publicado hace ', CAST(listing_id % 60 AS STRING), ' días')
      WHEN 2 THEN 'Published today' ELSE 'Publicado' END
  ) AS text
FROM {listing}
"""

# Tag columns ("pills") of each listing; an empty string and the word nan stand for missing.
_PILLS = """
SELECT listing_id, price, colonia,
  CASE listing_id % 5 WHEN 0 THEN 'Gimnasio equipado' WHEN 1 THEN 'Alberca techada' WHEN 2 THEN 'nan' WHEN 3 THEN '' END AS p0,
  CASE listing_id % 4 WHEN 0 THEN 'Jardín ' WHEN 1 THEN 'Circuito cerrado' WHEN 2 THEN 'ELEVADOR' END AS p1,
  CASE listing_id % 3 WHEN 0 THEN 'Terraza' WHEN 1 THEN 'Rooftop con asador' END AS p2,
  CASE listing_id % 7 WHEN 0 THEN 'Área de juegos' WHEN 1 THEN 'alberca' END AS p3
FROM {listing}
"""

# Answers of a text model to a valuation question, in several shapes.
_ANSWER = """
SELECT listing_id AS id, price,
  CASE listing_id % 10
    WHEN 0 THEN concat('El precio estimado es **$', CAST(CAST(floor(price / 10) AS INT) AS STRING), '** MXN al mes.')
    WHEN 1 THEN concat('$', CAST(CAST(floor(price / 10000) AS INT) AS STRING), ',500 MXN')
    WHEN 2 THEN concat('Renta de ', CAST(CAST(floor(price / 20) AS INT) AS STRING), ' pesos mensual')
    WHEN 3 THEN CAST(CAST(floor(price / 10) AS INT) AS STRING)
    WHEN 4 THEN 'No puedo estimar el precio de esa propiedad.'
    WHEN 5 THEN concat('Rango $', CAST(CAST(floor(price / 100) AS INT) AS STRING), ' a $', CAST(CAST(floor(price / 8) AS INT) AS STRING), ' MXN/mes')
    WHEN 6 THEN concat('Precio sugerido: $', CAST(CAST(floor(price / 12) AS INT) AS STRING), '.50 MXN. Uno. Dos! Tres? Cuatro.')
    WHEN 7 THEN concat('La estimación para la zona da $ ', CAST(CAST(floor(price / 9) AS INT) AS STRING), ' MXN al mes.')
    WHEN 8 THEN concat('```', CAST(CAST(floor(price) AS INT) AS STRING), '``` print(precio)')
    ELSE '' END AS answer
FROM {listing}
"""

VIEWS: dict[str, str] = {
    "listing": _LISTING,
    "poi": _POI,
    "prediction": _PREDICTION,
    "ad": _AD,
    "pills": _PILLS,
    "answer": _ANSWER,
}
_NEEDS = {"ad": ("listing",), "pills": ("listing",), "answer": ("listing",)}
_SPARK_PARTS = {
    "models": "array(named_struct('model','a','k',3), named_struct('model','b','k',5), named_struct('model','c','k',7))",
    "unnest_models": "LATERAL VIEW explode(o.ms) e AS m",
}
_DUCK_PARTS = {
    "models": "[{'model':'a','k':3},{'model':'b','k':5},{'model':'c','k':7}]",
    "unnest_models": ", UNNEST(o.ms) AS t(m)",
}


# Tables whose rows carry much work each (texts, or the base of the listing views).
_HEAVY = ("orders", "documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in _HEAVY else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table that has fewer files than the cluster has cores to all cores.

    Small test files hold one row group and would keep one core busy. A large table has many more
    files than that and is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 64) else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or one of the listing-domain views over them."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    for part, value in _SPARK_PARTS.items():
        text = text.replace("{" + part + "}", value)
    names = [t for t in (*TABLES, *VIEWS) if "{" + t + "}" in text]
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in names})


def with_views(*names: str) -> str:
    """``WITH`` clause declaring the named views (and what they need) for the oracle."""
    todo: list[str] = []
    for name in names:
        for item in (*_NEEDS.get(name, ()), name):
            if item not in todo:
                todo.append(item)
    parts = []
    for name in todo:
        text = VIEWS[name]
        for part, value in _DUCK_PARTS.items():
            text = text.replace("{" + part + "}", value)
        for other in (*TABLES, *VIEWS):
            text = text.replace("{" + other + "}", other)
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(parts)
