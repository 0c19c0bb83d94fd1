"""Nearest vectors by inner product: recall and scores against brute force, odd rows by hand."""

import numpy as np
import pytest
from pyspark.sql import types as T

from valora.llm.catalog import QUERIES
from valora.llm.dimension_scan import nearest_vectors, scan_tile

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("rank", T.StringType()), T.StructField("score", T.StringType()), T.StructField("qid", T.StringType()), T.StructField("list", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "a", "b", "c", "d") for i, e in rows], SCHEMA)


def brute(rows, wanted, k=20):
    ids, m = np.array([i for i, _ in rows]), np.array([e for _, e in rows], dtype=np.float64)
    out = {}
    for i, e in rows:
        if i in wanted:
            score = m @ np.array(e, dtype=np.float64)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def true_scores(got, rows):
    of = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(of[q], float), np.array(of[i], float))), rel=1e-12, abs=1e-12)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and q not in {i for i, _ in found}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})
    got = result(QUERIES["op12_dimension_scan"](spark, path))
    assert got.keys() == want.keys() and {len(f) for f in got.values()} == {20}
    true_scores(got, rows)
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_recall_over_many_lists_tiles_and_lengths(spark, spread):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    made = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * spread) * rng.uniform(0.2, 3, (3000, 1))
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(made)]
    longest = int(np.linalg.norm(made, axis=1).argmax())
    rows += [(5000 + i, rows[longest][1]) for i in range(100)]  # copies
    df = frame(spark, rows)
    got = result(nearest_vectors(df, df.where("vec_id % 20 = 0"), list_rows=60, tile_values=64 * 24, sample_rows=1000))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})
    assert got.keys() == want.keys() and {len(f) for f in got.values()} == {20}
    true_scores(got, rows)
    assert recall(got, want) >= 0.9
    # Of equal vectors those of the smallest ids are found, in order.
    copies = [longest, *range(5001, 5100)]
    found = [i for i, _ in got[5000] if i in copies]
    assert found == copies[:20]


def test_unusable_rows_few_rows_and_empty_tables(spark):
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]]
    rows = [(20 * i, e) for i, e in enumerate(odd)] + [(200, [1.0, 0.0]), (201, [2.0, 1.0]), (220, [-1.0, 0.0]), (221, [-1.0, 0.0]), (240, [1.0] * 3), (None, [9.0, 9.0])]
    df = frame(spark, rows + [(201, [2.0, 1.0])])
    got = result(nearest_vectors(df, df.where("vec_id % 20 = 0")))
    assert got == {200: [(201, 2.0), (220, -1.0), (221, -1.0)], 220: [(221, 1.0), (200, -1.0), (201, -2.0)]}
    assert result(nearest_vectors(df, df.where("vec_id % 20 = 0"), k=1))[220] == [(221, 1.0)]
    assert nearest_vectors(df.where("false"), df.where("false")).count() == 0
    assert nearest_vectors(df, df.where("false")).count() == 0


def test_scan_keeps_the_best_and_drops_most():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64)) * 0.3 + rng.normal(size=(40, 64))[rng.integers(0, 40, 2000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, r = np.linalg.qr(rng.normal(size=(64, 64)))
    turned = x @ q
    blocks = [turned[:, i:i + 16] for i in range(0, 64, 16)]
    ask = x[:5]
    at, row, score = scan_tile(blocks, x, ask @ q, ask, np.full(5, np.nan), 1.0, 10)
    hits = 0
    for i in range(5):
        true = set(np.argsort(-(x @ ask[i]))[:10])
        hits += len(true & set(row[at == i]))
    assert hits >= 48 and len(row) < 5 * 400
