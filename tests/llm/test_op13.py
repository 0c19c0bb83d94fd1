"""Importance resampling against brute force with the plain CRC of every n-gram."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import types as T

from valora.llm import importance_resampling as ir
from valora.llm.catalog import QUERIES

NAMES = ["id", "n_words", "features", "place", "weight"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(n, T.StringType()) for n in NAMES])


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words_of(text)
    return [crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5):
    of = [(i, features(t), len(words_of(t))) for i, t in docs]
    s, t = Counter(b for _, f, _ in of for b in f), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    out = {}
    for i, f, n in of:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((-out[i][2], i) for i, _, n in of if n >= 20)
    for rank, (_, i) in enumerate(fit[:len(fit) * percent // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def result(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in df.collect()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_documents(spark, folder):
    path = f"/root/testdata/{folder}"
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
    assert result(QUERIES["op13_importance_resampling"](spark, path)) == want
    assert len([1 for v in want.values() if v[3]]) > 5


def test_odd_texts(spark):
    base = "Some ÄRGER words, of MANY kinds ünd 12 numbers \x00 tabs\tand lines\nhere "
    rows = [(i, base * (i % 4) + f"own{i} " * 30) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "Two words"), (104, "!?"), (105, "x" * 70000 + " " + "y" * 66000 + " z"), (106, "long text " * 150000)]
    docs = spark.createDataFrame([(i, t, *"abcde") for i, t in rows], SCHEMA)
    target = spark.createDataFrame([(1, "many kinds of numbers and lines"), (2, None), (3, "")], "item_id long, text string")
    got = result(ir.resample(docs, target, percent=20))
    assert got == brute(rows, ["many kinds of numbers and lines"], 20)
    assert got[100][:2] == got[101][:2] == got[104][:2] == (0, 0) and got[102][0] == 1 and got[103][0] == 3
    assert result(ir.resample(docs, target.where("false"))) == brute(rows, [])
    assert ir.resample(docs.where("false"), target).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(None, text, *"abcde")] * 2 + [(7, text, *"abcde")] * 2, SCHEMA)
    got = ir.resample(docs, docs, percent=100).collect()
    assert sorted((r.doc_id, r.rank) for r in got if r.doc_id) == [(7, 1), (7, 2)]
    assert [(r.n_features, r.score, r.rank) for r in got if r.doc_id is None] == [(72, None, None)] * 2
    assert got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}


def test_shifts_cancel_what_stands_before():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 255, 256, 257, 70000, 17_000_000):
        a, b = rng.bytes(31), bytes(size)
        b = b[:size // 2] + b"q" + b[size // 2 + 1:] if size else b
        moved = ir.shift_crc(np.array([crc32(a)], dtype=np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ crc32(a + b) == crc32(b)


def test_pieces_of_a_text_change_nothing(monkeypatch):
    text = "Alpha, beta gamma-delta ünd epsilon " * 40
    want = ir.feature_buckets([text, "", "a b"], 3, 10000)[1]
    assert np.frombuffer(want[0], "<u2").tolist() == features(text)
    monkeypatch.setattr(ir, "PIECE", 5)
    monkeypatch.setattr(ir, "STEP", 7)
    assert ir.feature_buckets([text, "", "a b"], 3, 10000)[1] == want
