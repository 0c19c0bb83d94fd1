"""Queries for comparables, word search, vector search and the text built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed, render
from valora.functions.numeric import half_up
from valora.operators import approximate, retrieve, sampling, word_index
from valora.plans.registry import Context, query, rnd, sql_unit
from valora.session import scratch_path

_SPLIT = f"""CASE WHEN {sql_unit('listing_id', 42)} < 0.8 THEN 'train' ELSE 'test' END"""
_BONUS = "CASE WHEN q.municipio = p.municipio THEN 1.0 ELSE 0.0 END + CASE WHEN q.colonia = p.colonia THEN 10.0 ELSE 0.0 END"
_LESS = """coalesce(abs(CAST(q.recamaras AS DOUBLE) - CAST(p.recamaras AS DOUBLE)), 0.0) -
    coalesce(CASE WHEN q.m2 > 0 AND p.m2 > 0 THEN abs(q.m2 - p.m2) / greatest(q.m2, p.m2) END, 0.0)"""


def _similar_sql(score: str, k: int) -> str:
    return f""", s AS (SELECT *, {_SPLIT} AS split FROM listing), q AS (SELECT * FROM s WHERE split = 'test'), p AS (SELECT * FROM s WHERE split = 'train'),
        x AS (SELECT q.listing_id AS qid, p.listing_id AS id, {score} AS score FROM q CROSS JOIN p),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x)
        SELECT qid, CAST(rank AS INT) AS rank, id, {rnd('score', 6)} AS score FROM r WHERE rank <= {k}"""


def split_listings(c: Context) -> tuple[DataFrame, DataFrame]:
    """Test listings as questions, training listings as the pool."""
    rows = c.stored("listing", "listing_id", "colonia", "municipio", "recamaras", "m2", "price").withColumn(
        "split", sampling.split2("listing_id", 42))
    q = rows.filter("split = 'test'").withColumnRenamed("listing_id", "qid")
    return q, rows.filter("split = 'train'").withColumnRenamed("listing_id", "id")


@query("l1_similar", _similar_sql(f"CAST({_BONUS} AS DOUBLE) - {_LESS}", 3), "listing")
def _(c: Context) -> DataFrame:
    q, pool = split_listings(c)
    got = retrieve.similar(q, pool, 3)
    return got.select("qid", "rank", "id", half_up("score", 6).alias("score"))


@query(
    "l2_similar_anchored",
    _similar_sql(f"CAST({_BONUS} AS DOUBLE) - {_LESS} - abs(p.price - q.price * 1.07) / (q.price * 1.07) * 3", 3),
    "listing",
)
def _(c: Context) -> DataFrame:
    q, pool = split_listings(c)
    q = q.withColumn("anchor", F.col("price") * 1.07).withColumn("colonia", F.lower("colonia"))
    got = retrieve.similar(q, pool, 3, anchored=True, ignore_case=True)
    return got.select("qid", "rank", "id", half_up("score", 6).alias("score"))


_TOK = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_BM25 = f"""WITH d AS (SELECT doc_id AS id, {_TOK} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY ALL),
    df AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY token), n),
    e AS (SELECT avg(raw) * 0.25 AS eps FROM df),
    q AS (SELECT qid, token, count(*) AS qn FROM (SELECT item_id AS qid, unnest({_TOK}) AS token FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, id, {rnd('sum(qn * CASE WHEN raw < 0 THEN eps ELSE raw END * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))', 9)} AS score
      FROM q JOIN tf USING (token) JOIN df USING (token), n, e GROUP BY qid, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


def bm25_hits(c: Context, k: int) -> DataFrame:
    q = c.benchmark.select(F.col("item_id").alias("qid"), "text")
    return retrieve.bm25_topk(q, c.documents.select(F.col("doc_id").alias("id"), "text"), k)


@query("l3_bm25", _BM25 + f" SELECT qid, CAST(rank AS INT) AS rank, id, {rnd('score', 6)} AS score FROM r WHERE rank <= 3")
def _(c: Context) -> DataFrame:
    return bm25_hits(c, 3).select("qid", "rank", "id", half_up("score", 6).alias("score"))


@query("l3_bm25_index", _BM25 + f" SELECT qid, CAST(rank AS INT) AS rank, id, {rnd('score', 6)} AS score FROM r WHERE rank <= 3")
def _(c: Context) -> DataFrame:
    """The same from a stored index: documents come in two segments, and two sets of questions are asked."""
    path = scratch_path(c.spark, "word-index")
    docs = c.documents.select(F.col("doc_id").alias("id"), "text")
    for part in (docs.filter("id % 3 = 0"), docs.filter("id % 3 <> 0")):
        word_index.add_segment(part, path)
    q = c.benchmark.select(F.col("item_id").alias("qid"), "text")
    found = [word_index.search(c.spark, path, some, 3).rows for some in (q.filter("qid % 2 = 0"), q.filter("qid % 2 = 1"))]
    return found[0].unionByName(found[1]).select("qid", "rank", "id", half_up("score", 6).alias("score"))


@query(
    "l4_cosine_topk",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
        x AS (SELECT a.vec_id AS qid, b.vec_id AS id, {rnd('list_dot_product(a.e, b.e)', 9)} AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM x)
        SELECT qid, CAST(rank AS INT) AS rank, id, {rnd('sim', 6)} AS sim FROM r WHERE rank <= 5""",
)
def _(c: Context) -> DataFrame:
    rows = c.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got = retrieve.cosine_topk(rows.withColumnRenamed("id", "qid"), rows, 5, exclude_self=True)
    return got.select("qid", "rank", "id", half_up("sim", 6).alias("sim"))


@query("l4_cosine_approximate")
def _(c: Context) -> DataFrame:
    """Approximate: the tests measure its recall against ``l4_cosine_topk``."""
    rows = c.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got = approximate.approximate_cosine_topk(rows.withColumnRenamed("id", "qid"), rows, 5, exclude_self=True)
    return got.select("qid", "rank", "id", half_up("sim", 6).alias("sim"))


@query(
    "l5_property_text",
    """SELECT listing_id, concat_ws(' ', concat('Renta en ', colonia), colonia, municipio, recamaras || ' recamaras', CAST(m2 AS BIGINT) || ' metros') AS text FROM listing""",
    "listing",
)
def _(c: Context) -> DataFrame:
    rows = c.listing.withColumn("pregunta", F.concat(F.lit("Renta en "), "colonia"))
    return rows.select("listing_id", render.property_text().alias("text"))


_LINE = r"""concat('  ', rank, '. ', colonia, ' — ', coalesce(nullif(concat_ws(', ', CASE WHEN m2 > 1 THEN concat(CAST(m2 AS BIGINT), 'm²') END,
    CASE WHEN recamaras > 0 THEN concat(recamaras, ' rec') END, CASE WHEN amueblado = 1 THEN 'amueblado' END, CASE WHEN lujo = 1 THEN 'lujo' END), ''), 'sin datos'),
    ' → $', CASE WHEN pr < 1000 THEN CAST(pr AS VARCHAR) ELSE regexp_replace(CAST(pr AS VARCHAR), '(\d)(\d{3})$', '\1,\2') END, ' MXN/mes')"""


@query(
    "b41_format_examples",
    f""", t AS (SELECT *, CAST(row_number() OVER (PARTITION BY colonia ORDER BY price DESC, listing_id) AS INT) AS rank, CAST(round(price) AS BIGINT) AS pr FROM listing)
        SELECT colonia, string_agg({_LINE}, chr(10) ORDER BY rank) AS examples FROM t WHERE rank <= 3 GROUP BY colonia""",
    "listing",
)
def _(c: Context) -> DataFrame:
    from valora.operators.ordering import top_k

    top = top_k(c.listing, ["colonia"], [F.desc("price"), F.col("listing_id")], 3, "rank")
    return retrieve.format_examples(top.withColumn("grp", F.col("colonia")), "grp").select(F.col("grp").alias("colonia"), "examples")


@query(
    "l6_retrieval_context",
    _BM25 + f""" SELECT qid, concat('<|im_start|>system', chr(10), '{fixed.EXAMPLE_SYSTEM}', '<|im_end|>', chr(10), '<|im_start|>user', chr(10),
        'Propiedades similares en el mercado de Monterrey:', chr(10),
        string_agg(concat('  ', rank, '. ', lang, ' — sin datos → $', regexp_replace(CAST(n_chars + 1000 AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2'), ' MXN/mes'), chr(10) ORDER BY rank), chr(10), chr(10),
        CASE WHEN qid % 2 = 0 THEN concat('Precio estadístico: $25,000 MXN/mes', chr(10), chr(10)) ELSE '' END, 'Pregunta: ', any_value(b.text), '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS prompt
        FROM r JOIN documents ON doc_id = id JOIN benchmark b ON item_id = qid WHERE rank <= 5 GROUP BY qid""",
)
def _(c: Context) -> DataFrame:
    docs = c.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("colonia"), (F.col("n_chars") + 1000).alias("price"),
        *[F.lit(None).cast("int").alias(n) for n in ("m2", "recamaras", "amueblado", "lujo")])
    block = retrieve.format_examples(bm25_hits(c, 5).join(docs, "id"), "qid")
    rows = c.benchmark.select(F.col("item_id").alias("qid"), "text").join(block, "qid").withColumn("anchor", F.lit(25_000.0))
    system = F.lit(fixed.EXAMPLE_SYSTEM)
    with_price = retrieve.context_prompt(rows.filter("qid % 2 = 0"), "text", "examples", system, "anchor")
    without = retrieve.context_prompt(rows.filter("qid % 2 = 1"), "text", "examples", system)
    return with_price.unionByName(without).select("qid", "prompt")
