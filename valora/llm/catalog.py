"""Registered queries of this package, each over its whole table, and the SQL that can check them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm.bpe import decode, encode_documents, read_ranks
from valora.llm.common import table, text_or_empty
from valora.llm.dimension_scan import nearest_vectors
from valora.llm.embedding_join import link_vectors
from valora.llm.huffman_ids import read_id_files, write_id_files
from valora.llm.importance_resampling import resample
from valora.llm.license_automaton import scan_licences
from valora.llm.order_minhash import fingerprint_edits
from valora.llm.packing import cut_documents, pack_pieces
from valora.llm.sentence_spans import drop_repeated_passages
from valora.llm.simhash_trie import simhash_groups
from valora.llm.site_quality import score_documents
from valora.llm.vector_codes import encode_vectors
from valora.llm.zip_warc import list_records, read_records, write_packages

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
walk AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT w.a, l.b FROM walk w JOIN link l ON l.a = w.b),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM walk GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query
def op7_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = write_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_id_files(listing).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"), long_words=44)
    return kept.select("doc_id", "n_removed", F.length(text_or_empty()).cast("long").alias("n_chars"), F.sha2(text_or_empty(), 256).alias("text_sha256"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.col(c).alias(c[1:]) for c in ("_evidence", "_host", "_path", "_score", "_keep")])


@query
def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(list_records(write_packages(table(spark, sf_dir, "pages")))).drop("payload", "url")


ORACLES["op6_zip_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest
"""


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), read_ranks(path)), 256).alias("decoded_sha256"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def _moved_books(books: str, assigned: str) -> str:
    """SQL of the codebooks after a round: the floor of the mean of each entry's parts; unused entries stay."""
    return f"""
  SELECT b.k, b.c, coalesce(n.m, b.m) AS m FROM {books} b LEFT JOIN (
    SELECT k, c, list(CAST(v AS BIGINT) ORDER BY i) AS m
    FROM (SELECT k, c, i, floor(sum(x[i]) / count(*)) AS v FROM {assigned}, wide, range(1, w + 1) t(i) GROUP BY k, c, i) GROUP BY k, c) n
  ON b.k = n.k AND b.c = n.c"""


def _nearest_books(books: str) -> str:
    """SQL of every part's nearest entry; distance and index as one number, so that ties go to the first."""
    return f"""
  SELECT vec_id, label, k, any_value(x) AS x, min(d * 64 + c) % 64 AS c, min(d * 64 + c) // 64 AS d
  FROM (SELECT p.*, b.c, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, m)]) AS BIGINT) AS d FROM p JOIN {books} b ON p.k = b.k)
  GROUP BY vec_id, label, k"""


ORACLES["op11_vector_codes"] = f"""
WITH v AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
wide AS (SELECT CAST(max(len(e)) // 16 AS BIGINT) AS w FROM v),
p AS (SELECT vec_id, label, k, e[k * w + 1:(k + 1) * w] AS x FROM v, wide, range(16) t(k)),
b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS c, x AS m
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
a0 AS ({_nearest_books('b0')}),
b1 AS ({_moved_books('b0', 'a0')}),
a1 AS ({_nearest_books('b1')}),
b2 AS ({_moved_books('b1', 'a1')}),
a2 AS ({_nearest_books('b2')}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(c AS BIGINT)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY k, c)) FROM b2) AS codebooks_sha256
FROM r
"""


@query
def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
