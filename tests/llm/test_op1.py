"""Vectors near each other against brute force and by hand."""

import numpy as np
from pyspark.sql import types as T

from valora.llm.embedding_join import link_vectors

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("rep", T.StringType()), T.StructField("cell", T.StringType()), T.StructField("component_id", T.StringType()),
])


def brute(rows):
    ok = {i: np.array(e, float) for i, e, l, *_ in rows if l is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    label = {r[0]: r[2] for r in rows}
    near = {i: [j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j])
                and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93] if i in ok else [] for i, *_ in rows}
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_small_tiles_and_many_pivots_change_nothing(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.35], i % 2, "x", "y", "z") for i in range(240)]
    rows += [(300 + i, rows[7][1], 1, None, None, None) for i in range(30)]  # copies
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, [float(np.float32(x)) for x in e], l) for i, e, l, *_ in rows])
    assert result(link_vectors(df, tile_rows=16, max_pivots=7)) == want
    assert result(link_vectors(df)) == want


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0]]
    rows = [(i, e, 1, None, None, None) for i, e in enumerate(odd)]
    rows += [(20, [1.0, 0.0], 1, None, None, None), (21, [2.0, 0.0], 1, None, None, None), (22, [2.0, 0.0], None, None, None, None)]
    got = result(link_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert got == {i: (0, i, True) for i in range(7)} | {20: (1, 20, True), 21: (1, 20, False), 22: (0, 22, True)}


def test_empty_null_ids_and_repeated_rows(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0], 1, None, None, None), (5, [1.0], 1, None, None, None), (5, [1.0], 1, None, None, None)]
    got = sorted(map(tuple, link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True)]
