"""The stored word index against plain Okapi BM25."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from valora.operators import word_index
from valora.operators.retrieve import bm25_topk


def brute(queries, docs, k, k1=1.5, b=0.75, epsilon=0.25):
    words = {i: (t or "").lower().split() for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / max(len(docs), 1) or 1.0
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = epsilon * sum(raw.values()) / len(raw)
    out = {}
    for q, t in queries:
        ask = Counter(t.lower().split())
        scores = {}
        for i, ws in words.items():
            tf = Counter(ws)
            if set(ask) & set(ws):
                scores[i] = sum(c * (low if raw[w] < 0 else raw[w]) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w, c in ask.items() if w in tf)
        out[q] = sorted(((round(-s, 9), i) for i, s in scores.items()))[:k]
    return {q: [(i, -s) for s, i in found] for q, found in out.items() if found}


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


def near(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_segments_and_query_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(word_index, "BLOCK", 8)  # many blocks a word
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    heavy = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(vocabulary, heavy, k=rnd.randint(0, 60)))) for i in range(900)] + [(900, None), (901, "")]
    asks = [(q, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 6)))) for q in range(40)] + [(40, "w0 w1 w2"), (41, "nothing here"), (42, "")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} LONG, text STRING")
    path = str(tmp_path / "index")
    word_index.add_segment(frame(docs[:500], "id"), path)
    near(result(word_index.search(spark, path, frame(asks, "qid"), 4, seed_postings=40).rows), brute(asks, docs[:500], 4))
    files = {p for p in (tmp_path / "index").rglob("*.parquet")}
    word_index.add_segment(frame(docs[500:], "id"), path)
    assert files < {p for p in (tmp_path / "index").rglob("*.parquet")}  # the first segment stays as it is
    hits = word_index.search(spark, path, frame(asks, "qid"), 4, seed_postings=40)
    near(result(hits.rows), brute(asks, docs, 4))
    near(result(bm25_topk(frame(asks, "qid"), frame(docs, "id"), 4)), brute(asks, docs, 4))
    read = hits.read.first()
    assert 0 < read.postings_read < read.postings


def test_most_blocks_of_common_words_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(word_index, "BLOCK", 4)
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices(["the", "of", "and", *[f"c{j}" for j in range(40)]], k=rnd.randint(5, 80)) + [f"r{i % 400}"])) for i in range(2000)]
    asks = [(q, f"r{q} c{q} the of") for q in range(10)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} LONG, text STRING")
    path = str(tmp_path / "index")
    word_index.add_segment(frame(docs, "id"), path)
    hits = word_index.search(spark, path, frame(asks, "qid"), 3, epsilon=0.05, seed_postings=60)
    near(result(hits.rows), brute(asks, docs, 3, epsilon=0.05))
    read = hits.read.first()
    assert read.postings_read < 0.3 * read.postings


def test_an_unfinished_segment_does_not_count(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} LONG, text STRING")
    word_index.add_segment(frame([(1, "a b"), (2, "b c"), (3, "d")], "id"), path)
    want = result(word_index.search(spark, path, frame([(1, "a c")], "qid"), 5).rows)
    broken = spark.read.parquet(f"{path}/blocks").withColumn("segment", F.lit("broken"))
    broken.write.mode("append").parquet(f"{path}/blocks")
    assert result(word_index.search(spark, path, frame([(1, "a c")], "qid"), 5).rows) == want and len(want[1]) == 2


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    word_index.add_segment(spark.createDataFrame([], "id LONG, text STRING"), path)
    assert word_index.search(spark, path, spark.createDataFrame([(1, "a")], "qid LONG, text STRING")).rows.count() == 0


def test_search_in_many_small_blocks(spark, monkeypatch):
    """Blocks of 7 documents and 2 queries give the same as brute force, also for common words and documents without words."""
    from valora.operators import retrieve

    monkeypatch.setattr(retrieve, "DOCS", 7)
    monkeypatch.setattr(retrieve, "QUERIES", 2)
    docs = [(i, f"casa {'de' if i % 3 else 'en'} w{i % 5} w{i % 7} " * (1 + i % 3)) for i in range(60)] + [(60, ""), (61, "otra")]
    asks = [(i, f"casa w{i} w{i + 1} de") for i in range(5)] + [(5, "nada"), (6, "otra otra")]
    questions, texts = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in ((asks, "qid"), (docs, "id")))
    near(result(bm25_topk(questions, texts, 4)), brute(asks, docs, 4))


def test_documents_are_scored_in_many_parts(spark, tmp_path, monkeypatch):
    """Parts of 50 documents and 3 queries give the same, and their hash is the one that Spark dealt the blocks by."""
    monkeypatch.setattr(word_index, "BLOCK", 8)
    monkeypatch.setattr(word_index, "DOCS", 50)
    monkeypatch.setattr(word_index, "QUERIES", 3)
    rnd = random.Random(5)
    docs = [(rnd.choice([-1, 1]) * i * 10**12 + i, " ".join(rnd.choices([f"w{j}" for j in range(90)], [1 / (j + 1) for j in range(90)], k=rnd.randint(0, 70)))) for i in range(600)]
    asks = [(q, " ".join(rnd.choices([f"w{j}" for j in range(95)], k=rnd.randint(1, 9)))) for q in range(20)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} LONG, text STRING")
    hashed = frame(docs, "id").select("id", F.xxhash64("id").alias("h")).collect()
    assert word_index._hash(word_index.np.array([r.id for r in hashed])).tolist() == [r.h for r in hashed]
    word_index.add_segment(frame(docs, "id"), str(tmp_path / "index"))
    hits = word_index.search(spark, str(tmp_path / "index"), frame(asks, "qid"), 4, seed_postings=60)
    near(result(hits.rows), brute(asks, docs, 4))
    read = hits.read.first()
    assert 0 < read.postings_read < read.postings
