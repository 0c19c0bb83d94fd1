"""Byte-level BPE against the tiktoken library."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F, types as T

from valora.llm import catalog
from valora.llm.bpe import byte_literal, decode, encode_documents, fold_word, let, rank_literal, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                       T.StructField("words", T.StringType()), T.StructField("docs", T.StringType())])
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \n b", "a\n\n bc", "x \n\n  y\t z", "it's 's  't'll", "　a　 b", "a 　b", "\xa0 \xa0x",
       "<|endoftext|> a<|endoftext|>", "é ß 漢字 𝔘 1234 5 ... !? --", "a" * 5000, "xyzzy" * 13, "word " * 20000, "\x1c \x85 a", "a \x1c b", "᠎ ​ x", "ǅ ⅷ ² ١"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_odd_texts(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    for size in (32_000_000, 50):
        coded = encode_documents(df, PATH, P.PATTERN, block_chars=size).withColumn("back", decode(F.col("ids"), read_ranks(PATH)))
        assert sorted((str(r.doc_id), r.ids, bytes(r.back)) for r in coded.collect()) == want
    assert encode_documents(df.where("false"), PATH, P.PATTERN).count() == 0


def test_given_documents(spark, sf_dir, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.QUERIES["op8_byte_bpe"](spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(d.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got.pop(d.doc_id) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((d.text or "").encode()))
    assert not got


def test_fold(spark, library):
    ranks = read_ranks(PATH)
    # A step's cost is its array expressions, which Spark interprets: it rebuilds one array, by two slices.
    fold = fold_word(F.col("w"), F.col("r"), F.col("b"))
    assert str(fold).count("slice(") <= 4 and "concat(" not in str(fold)
    words = ["a" * 64, "ab" * 32, "aab" * 21, "\U0001d518" * 16, "b" + "a" * 62, "zq", " unleenauxeau", " Enoublereeringes", "x"]
    rows = [(i, list(w.encode())) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "i int, w array<int>")
    for r in df.select("i", let(rank_literal(ranks), lambda r: let(byte_literal(ranks), lambda b: fold_word(F.col("w"), r, b))).alias("ids")).collect():
        assert r.ids == library._encode_single_piece(words[r.i].encode())
