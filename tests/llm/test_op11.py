"""Vector codes against exact integers by brute force and against SQL."""

import hashlib
from fractions import Fraction
from math import floor

import numpy as np
from compare import compare, oracle
from pyspark.sql import types as T

from valora.llm.catalog import ORACLES, QUERIES
from valora.llm.vector_codes import encode_vectors, exact_products, split_limbs

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("code", T.StringType()), T.StructField("of", T.StringType()), T.StructField("error", T.StringType()),
])


def brute(rows, parts, entries, rounds):
    """Plain Python integers; ``rows`` have one id each."""
    fine = sorted((i, [floor(256 * Fraction(x)) for x in e], l) for i, e, l in rows if e is not None and None not in e and np.isfinite(e).all())
    d = len(fine[0][1]) // parts
    cut = lambda e: [e[k * d:(k + 1) * d] for k in range(parts)]
    books = [[cut(e)[k] for _, e, _ in fine[:entries]] for k in range(parts)]
    far = lambda x, m: sum((a - b) ** 2 for a, b in zip(x, m))
    assign = lambda: [[min((far(x, m), c) for c, m in enumerate(books[k])) for k, x in enumerate(cut(e))] for _, e, _ in fine]
    for _ in range(rounds):
        got = assign()
        for k in range(parts):
            for c in range(len(books[k])):
                members = [cut(e)[k] for (_, e, _), a in zip(fine, got) if a[k][1] == c]
                if members:
                    books[k][c] = [sum(col) // len(members) for col in zip(*members)]
    got = assign()
    digest = hashlib.sha256(",".join(str(v) for k in books for m in k for v in m).encode()).hexdigest()
    error = {i: sum(a[0] for a in g) for (i, _, _), g in zip(fine, got)}
    whole = {l: sum(error[i] for i, _, m in fine if m == l) for _, _, l in fine}
    return {i: ("".join(f"{a[1]:02x}" for a in g), error[i], whole[l], digest) for (i, _, l), g in zip(fine, got)}


def result(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, e, l, "x", "y", "z") for i, e, l in rows], SCHEMA)


def test_same_as_sql(spark, sf_dir):
    got = QUERIES["op11_vector_codes"](spark, sf_dir)
    assert compare(got, oracle(sf_dir), ORACLES["op11_vector_codes"]) is None


def test_ties_unused_entries_and_few_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 7 % 101, [float(np.float32(x)) for x in rng.normal(size=8) * 3], None if i % 5 == 0 else i % 3) for i in range(60)]
    rows += [(200 + i, rows[4][1], 1) for i in range(20)]  # copies: entries that nothing takes
    rows += [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, 1)]
    assert result(encode_vectors(frame(spark, rows), parts=4, entries=12)) == brute(rows, 4, 12, 2)
    assert result(encode_vectors(frame(spark, rows[:3]), parts=4, entries=12)) == brute(rows[:3], 4, 12, 2)
    copies = [(i, [0.5] * 8, 0) for i in range(9)]
    assert {c for c, *_ in result(encode_vectors(frame(spark, copies), parts=4, entries=4)).values()} == {"00000000"}


def test_odd_lengths_null_ids_repeats_and_empty_tables(spark):
    whole = [(i, [float(i), 1.0, -2.0, 0.25], 0) for i in range(6)]
    odd = [(50, [], 0), (51, [1.0] * 3, 0), (52, [1.0] * 8, None)]
    got = result(encode_vectors(frame(spark, whole + odd), parts=2, entries=3))
    want = brute(whole, 2, 3, 2)
    assert {i: got[i] for i, *_ in whole} == want and all(got[i][:2] == (None, None) for i, *_ in odd)
    again = encode_vectors(frame(spark, [*whole, whole[0], (None, whole[1][1], 0)]), parts=2, entries=3)
    assert again.count() == 8 and len({r.codebooks_sha256 for r in again.collect()}) == 1
    assert encode_vectors(frame(spark, whole).where("false")).count() == 0
    assert encode_vectors(frame(spark, [(None, [1.0, 2.0], None)]), parts=2).first().code == "0000"
    assert again.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_limbs_give_exact_products():
    rng = np.random.default_rng(0)
    for high in (300, 1 << 26, 1 << 29):
        a, b = rng.integers(-high, high, (7, 4)), rng.integers(-high, high, (5, 4))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert exact_products(a, b).tolist() == want
        parts = split_limbs(a, 11)
        assert all(np.abs(p).max() <= 1 << 11 for p in parts)
        assert (sum(p.astype(np.int64) << (11 * i) for i, p in enumerate(parts)) == a).all()
