"""Approximate vector search: recall against the exact one, exact similarities, odd rows."""

import numpy as np
import pytest

from valora.operators.approximate import approximate_cosine_topk, probe_order
from valora.operators.retrieve import cosine_topk
from valora.plans.catalog import QUERIES

SCHEMA = "id LONG, vec ARRAY<DOUBLE>"


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.id, round(r.sim, 6)))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    path = f"/root/testdata/{folder}"
    got, want = (result(QUERIES[n](spark, path)) for n in ("l4_cosine_approximate", "l4_cosine_topk"))
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(exact.get((q, i), s) == s for q, w in got.items() for i, s in w) and all(q not in dict(w) for q, w in got.items())


def test_recall_with_many_buckets_and_copies(spark):
    rng = np.random.default_rng(12)
    made = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 32)) * 0.4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(5000 + i, [float(x) for x in made[7]]) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    ask = df.where("id % 10 = 0").withColumnRenamed("id", "qid")
    got = result(approximate_cosine_topk(ask, df, 5, exclude_self=True, bucket=32, tile=64))
    want = result(cosine_topk(ask, df, 5, exclude_self=True))
    assert recall(got, want) >= 0.9
    # Copies: the smallest ids, without the asking one.
    assert [i for i, _ in got[5000]] == [7, 5001, 5002, 5003, 5004]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 1.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(approximate_cosine_topk(df.withColumnRenamed("id", "qid"), df, 2))
    assert got == {6: [(6, 1.0), (7, 1.0)], 7: [(6, 1.0), (7, 1.0)], 8: [(8, 1.0), (6, 0.707107)], 9: [(9, 1.0)]}
    assert approximate_cosine_topk(df.withColumnRenamed("id", "qid").where("false"), df).count() == 0
    assert approximate_cosine_topk(df.withColumnRenamed("id", "qid"), df.where("false")).count() == 0


def test_cheapest_flips_first():
    margins = np.array([[0.1, -2.0, 0.3, 5.0]])
    assert probe_order(margins, 4).tolist() == [[0, 1, 4, 5]]


def test_visits_are_sent_in_slices(spark, monkeypatch):
    """Slices of any size give the same rows; whole batches of eight copies of each question were sent at once."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)], SCHEMA)
    want = result(approximate_cosine_topk(rows.withColumnRenamed("id", "qid"), rows, 3, bucket=32))
    monkeypatch.setattr("valora.operators.approximate.SENT", 37)
    assert result(approximate_cosine_topk(rows.withColumnRenamed("id", "qid"), rows, 3, bucket=32)) == want
