"""Token ids, packing and coded files against the tokenizers library and exact round trips."""

import heapq
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from valora.llm import catalog
from valora.llm.huffman_ids import canonical_codes, code_lengths, decode_blocks, decode_table, encode_ids, read_id_files, write_id_files
from valora.llm.packing import best_fit, cut_documents, pack_pieces
from valora.llm.tokens import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                       T.StructField("length", T.StringType()), T.StructField("part", T.StringType())])
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \n b", "a\n\n bc", "x \n\n  y\t z", "it's 's  't'll", "　a　 b", "a 　b", "\xa0 \xa0x",
       "<|endoftext|> a<|endoftext|>", "é ß 漢字 𝔘 1234 5 ... !? --", "a" * 5000, "word " * 20000, "\x1c \x85 a"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_chunks_give_the_ids_of_whole_texts(spark, sf_dir, tokenizer):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for cache in (1_000_000, 50):
        e = ChunkEncoder(PATH, cache)
        got = [x for i in range(0, len(texts), 20) for x in e.encode(texts[i:i + 20])]
        for t, x in zip(texts, got):
            assert np.frombuffer(x, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:40])


def check_packing(rows, limit=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packed_documents(spark, sf_dir, tokenizer):
    rows = catalog.QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    total = 0
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, at = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0], 0
        total += len(ids)
        got = sorted(pieces.pop(d.doc_id), key=lambda r: r.piece)
        assert len(got) == max(1, -(-len(ids) // 2048))
        for k, r in enumerate(got):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at:at + r.length]))
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    assert not pieces
    assert check_packing(rows) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 300)
    bins, offsets = best_fit(sizes, np.array([100, 3, 4000.0]), np.array([1, 0.1, 0.1]), rule)
    for b in np.unique(bins):
        inside = bins == b
        assert sizes[inside].sum() <= 100 and inside.sum() <= 3 and (sizes[inside] ** 2).sum() <= 4000
        assert sorted(offsets[inside]) == sorted(np.cumsum(sizes[inside][np.argsort(offsets[inside])]) - sizes[inside][np.argsort(offsets[inside])])


def test_packing_in_many_groups_places_every_piece(spark):
    rows = [(i % 400, 0, 0, 1 + i * 37 % 900) for i in range(3000)] + [(9, 0, 0, 1024)] * 1000  # repeated rows, ties
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long")
    got = pack_pieces(df, limit=1024, group_rows=512).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    at_once = best_fit(np.array([r[3] for r in rows if r[3] < 1024]), np.array([1024, 1024, 1024.0 ** 2]), np.array([1, 1e-4, 1e-4]))[0].max() + 1
    assert check_packing(got, 1024) <= 1000 + at_once * 1.04
    few = pack_pieces(df, limit=1024, max_documents=2, group_rows=500).collect()
    assert max(__import__("collections").Counter(r.sequence_id for r in few).values()) == 2
    assert pack_pieces(df.where("false")).count() == 0


def test_odd_documents(spark, tokenizer):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(None, None, None, None, None), (None, "b", None, None, None), (3, "a", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((str(i), len(ids), crc(ids)) for i, t, *_ in rows for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [2]])
    got = read_id_files(write_id_files(docs, PATH, files=3)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert read_id_files(write_id_files(docs.where("false"), PATH)).count() == 0
    cut = cut_documents(docs, PATH, limit=100).where("doc_id = 19").orderBy("piece").collect()
    assert [r.piece for r in cut] == list(range(len(cut))) and {r.length for r in cut[1:]} == {100}


def test_given_documents_from_files(spark, sf_dir, tokenizer):
    at, got = 0, {r.doc_id: r for r in catalog.QUERIES["op7_huffman_token_ids"](spark, sf_dir).collect()}
    for d in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def huffman_cost(counts):
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_codes_are_optimal_prefix_free_and_limited():
    rng = np.random.default_rng(2)
    for n in (2, 3, 17, 400):
        counts = rng.integers(0, 50, n) ** 2
        counts[:2] = 1
        lengths = code_lengths(counts, 30)  # the limit does not bind
        assert (lengths.astype(int) * counts).sum() == huffman_cost(counts)
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    for counts in (np.array(fib), np.array([5]), np.array([0, 7, 0]), np.ones(1 << 16, int)):
        lengths = code_lengths(counts)
        assert lengths.max() <= 16 and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        codes = canonical_codes(lengths)
        docs = [rng.choice(np.nonzero(counts)[0], size) for size in (0, 1, 256, 257, 5000)]
        for d, (data, blocks) in zip(docs, encode_ids(docs, codes, lengths)):
            n = np.minimum(256, len(d) - 256 * np.arange(len(blocks)))
            assert decode_blocks(data, blocks, n, *decode_table(lengths)).tolist() == d.tolist()


def test_added_tokens_as_the_library_takes_them(spark, tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "a <|endof text|> b"]
    e = ChunkEncoder(PATH, 100)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(e.encode(texts)[0], "<u4").tolist() == [64, 220, 50256, 275]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_id_files(write_id_files(docs, PATH)).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_bins_that_stay_open_are_kept(spark, monkeypatch):
    monkeypatch.setattr("valora.llm.packing.LEVELS", 2)
    rng = np.random.default_rng(6)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 1500, 600))]
    got = pack_pieces(spark.createDataFrame(rows, "doc_id long, length long"), group_rows=16).collect()
    assert sorted((r.doc_id, r.length) for r in got) == rows
    check_packing(got)


def test_null_ids_in_files_of_their_own(spark):
    rows = [(None, f"text {i % 7}", "", "", "") for i in range(60)] + [(i, f"doc {i}", "", "", "") for i in range(50, 0, -1)]
    got = read_id_files(write_id_files(spark.createDataFrame(rows, SCHEMA), PATH, files=3)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 60 + list(range(1, 51))
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
