"""Operators against brute force on small fixtures, with one group holding most of the rows."""

import datetime
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.operators import aggregate, encode, evaluate, geo, joins, ordering, quantile, retrieve, sampling
from valora.streaming import incremental


def skewed(n=600, seed=3):
    """Half of the rows share one key, a third of the values are equal, some are missing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 2 else (None if i % 10 == 0 else f"k{i % 7}")
        v = 5.0 if i % 3 == 0 else (None if i % 17 == 0 else round(rnd.lognormvariate(0, 3), 3))
        rows.append((i, key, v))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(skewed(), "id BIGINT, k STRING, v DOUBLE").repartition(4)


def groups():
    out = {}
    for _, k, v in skewed():
        if v is not None:
            out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(rows, accuracy):
    got = {r.k: r for r in quantile.exact_quantiles(rows, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.99}, accuracy).collect()}
    want = groups()
    assert set(got) == set(want)
    for k, vs in want.items():
        assert got[k].n == len(vs)
        np.testing.assert_allclose([got[k].a, got[k].m, got[k].z], np.quantile(vs, [0.05, 0.5, 0.99]), rtol=1e-12)


def test_quantiles_beyond_one_window(rows, monkeypatch):
    monkeypatch.setattr(quantile, "WINDOW_ROWS", 0)
    got = {r.k: r.m for r in quantile.exact_quantiles(rows, ["k"], "v", {"m": 0.9}, 50).collect()}
    for k, vs in groups().items():
        assert got[k] == pytest.approx(np.quantile(vs, 0.9))
    everything = [v for vs in groups().values() for v in vs]
    assert quantile.exact_quantiles(rows, [], "v", {"m": 0.25}).first().m == pytest.approx(np.quantile(everything, 0.25))


def test_quantile_of_nothing(spark):
    empty = spark.createDataFrame([], "k STRING, v DOUBLE")
    assert quantile.exact_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    assert spark.range(1).select(quantile.scalar_quantile(empty, "v", 0.5)).first()[0] is None


def test_row_numbers_over_a_hot_group(rows):
    got = {r.id: r.rn for r in ordering.numbered(rows, ["k"], [F.col("v"), F.col("id")]).collect()}
    for key in {k for _, k, _ in skewed()}:
        own = sorted(((v is not None, v or 0.0, i) for i, k, v in skewed() if k == key))
        assert [got[i] for _, _, i in own] == list(range(1, len(own) + 1))


def test_running_totals(rows):
    got = {r.id: r.before for r in ordering.running_before(rows, [], [F.col("id")], F.col("id")).collect()}
    assert all(got[i] == i * (i - 1) // 2 for i in range(600))


def test_first_per_key_treats_missing_keys_as_one(rows):
    got = {r.k: r.id for r in ordering.first_by(rows, ["k"], [F.col("id")]).collect()}
    want = {}
    for i, k, _ in skewed():
        want.setdefault(k, i)
    assert got == want


def test_out_of_fold_encoding_equals_a_loop(spark):
    rnd = random.Random(1)
    data = [(i, "hot" if i % 2 else f"c{i % 9}", rnd.random() * 100, i % 4) for i in range(200)] + [(999, "alone", 7.0, 1)]
    df = spark.createDataFrame(data, "id INT, c STRING, y DOUBLE, fold INT")
    got = {r.id: r.c_enc for r in encode.target_encode_oof(df, ["c"], "y", "fold", 10).collect()}
    for i, c, _, f in data:
        rest = [y for _, _, y, g in data if g != f]
        own = [y for _, d, y, g in data if g != f and d == c]
        gm = sum(rest) / len(rest)
        want = (sum(own) + gm * 10) / (len(own) + 10) if own else gm
        assert got[i] == pytest.approx(want)


def test_boxcox_exponent_is_the_maximum(spark):
    rnd = np.random.default_rng(5)
    x = (rnd.normal(60, 10, 800) * 0.5 + 1) ** 2  # Box-Cox with exponent 0.5 makes this normal
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    lam = encode.fit_boxcox(df, "x")

    def llf(p):
        y = np.log(x) if p == 0 else (x**p - 1) / p
        return (p - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    assert all(llf(lam) >= llf(lam + d) for d in (-0.01, 0.01))


def test_median_imputation_and_labels(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, None), (10.0, "b"), (None, "c")], "x DOUBLE, c STRING")
    assert [r.x for r in encode.impute_median(df, ["x"]).collect()][-1] == 3.0
    assert {r.c: r.code for r in encode.label_encode(df, "c", "code").collect()} == {"a": 0, "b": 1, "c": 2, None: None}


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [0.0001, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p DOUBLE").coalesce(1).select(encode.normal_quantile(F.col("p"))).collect()
    assert [g[0] for g in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_fuzzy_category(spark):
    enc = spark.createDataFrame([("Cumbres", 1.0, 9.0), ("Del Valle", 2.0, 9.0), ("Valle Oriente", 3.0, 9.0), ("roma", 4.0, 9.0)], "key STRING, enc DOUBLE, global_mean DOUBLE")
    asked = ["Cumbres", "del valle", "CUMBRES", "valle", "VALLE O", "ro", "x", None, "zzzz", "Valle  Oriente"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i INT, zone STRING")
    got = {r.i: r.zone_enc for r in joins.resolve_category(df, enc, "zone").collect()}
    # CUMBRES matches title case, valle and VALLE O the first key containing them, a missing one the first key.
    assert [got[i] for i in range(len(asked))] == [1.0, 2.0, 1.0, 2.0, 3.0, 4.0, 9.0, 1.0, 9.0, 9.0]


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("lat0,lon0", [(25.65, -100.3), (0.0, 180.0), (-59.9, -180.0), (70.0, 179.99), (79.99, -100.3), (89.98, 30.0), (-89.98, -179.99)])
def test_radius_counts_equal_brute_force(spark, lat0, lon0):
    def place(i):
        if i % 3 == 0:
            return lat0, lon0
        # Near a pole longitudes are spread over the whole turn.
        wide = 180 if abs(lat0) > 89 else 0.03
        lat, lon = max(-90.0, min(90.0, lat0 + rnd.uniform(-0.03, 0.03))), lon0 + rnd.uniform(-wide, wide)
        return lat, (lon + 180) % 360 - 180

    rnd = random.Random(7)
    pts = [(i, *place(i)) for i in range(90)]
    tgs = [(*place(i), ["a"] if i % 2 else ["a", "b"]) for i in range(400)]
    p = spark.createDataFrame(pts, "id INT, lat DOUBLE, lon DOUBLE")
    t = spark.createDataFrame(tgs, "lat DOUBLE, lon DOUBLE, cats ARRAY<STRING>")
    got = {r.id: r for r in geo.radius_counts(p, t, "id", [0.5, 1.0], ["a", "b"]).collect()}
    for i, la, lo in pts:
        for r, name in ((0.5, "500m"), (1.0, "1000m")):
            near = [c for a, b, c in tgs if hav(la, lo, a, b) <= r]
            assert got[i][f"a_{name}"] == len(near)
            assert got[i][f"b_{name}"] == sum("b" in c for c in near)


def test_dense_cells_are_split(spark):
    rnd = random.Random(21)
    dense = [(25.67 + rnd.gauss(0, 0.0004), -100.31 + rnd.gauss(0, 0.0004)) for _ in range(1350)]  # 90 % within some 100 m
    around = [(25.67 + rnd.uniform(-0.006, 0.006), -100.31 + rnd.uniform(-0.006, 0.006)) for _ in range(150)]
    rows = [(i, a, b, ["a"] if i % 3 else ["a", "b"]) for i, (a, b) in enumerate(dense + around)]
    df = spark.createDataFrame(rows, "id INT, lat DOUBLE, lon DOUBLE, cats ARRAY<STRING>")
    radii = [0.1, 0.5]
    got = {r.id: r for r in geo.radius_counts(df, df, "id", radii, ["a", "b"], leaf=64).collect()}
    lat, lon = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
    has_b = np.array([len(r[3]) == 2 for r in rows])
    for i in range(0, 1500, 7):
        h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        d = 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        want = [int(((d <= r) & m).sum()) for m in (np.ones(1500, bool), has_b) for r in radii]
        assert [got[i].a_100m, got[i].a_500m, got[i].b_100m, got[i].b_500m] == want
    compared, unsplit = (geo.pairs_compared(df, df, radii, ["a"], leaf=n) for n in (64, 10_000))
    assert compared < 0.4 * unsplit



def test_row_numbers_with_more_bins_than_rows_of_a_bin(spark, rows):
    order = [F.col("k").asc_nulls_first(), F.col("id")]
    for bins in (2, 37, 700):
        got = ordering.running_before(rows, [], [F.coalesce("k", F.lit("")), F.col("id")], bins=bins).collect()
        want = {r.id: i for i, r in enumerate(rows.orderBy(*order).collect())}
        assert {r.id: r.before for r in got} == want


def test_distance_from_normal_is_taken_at_every_residual(spark):
    from statistics import NormalDist, fmean, pstdev

    from valora.operators.models import residual_shape

    rnd = random.Random(11)
    data = {"a": [rnd.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(60)], "b": [rnd.expovariate(1) for _ in range(50)], "c": [2.0] * 5}
    df = spark.createDataFrame([(m, v) for m, vs in data.items() for v in [*vs, None]], "model STRING, res DOUBLE")
    got = {r.model: r for r in residual_shape(df, "res").collect()}
    for m in "ab":
        vs, n = sorted(data[m]), len(data[m])
        cdf = NormalDist(fmean(vs), pstdev(vs)).cdf
        want = max(max(cdf(v) - sum(x < v for x in vs) / n, sum(x <= v for x in vs) / n - cdf(v)) for v in vs)
        assert got[m].n == n and abs(got[m].ks - want) < 1e-4
    assert got["c"].n == 5 and got["c"].ks is None


def listings(n, seed, hot=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        zone = "hot" if hot and i % 2 else rnd.choice(["a", "b", "c", None, ""])
        town = rnd.choice(["t1", "t2", None])
        out.append((i, zone, town, rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, 0.0, 40.0, 50.0, 60.0, 75.5, 90.0, 120.0, 300.0]), float(rnd.choice([5000, 8000, 8000, 12000, 30000]) + rnd.randrange(3) * 100)))
    return out


def brute_similar(qs, pool, k, anchored):
    out = {}
    for qid, zone, town, rooms, m2, anchor in qs:
        scored = []
        for pid, z, t, r, m, price in pool:
            s = 0.0
            s += 1 if town and town == t else 0
            s += 10 if zone and zone == z else 0
            s -= abs(rooms - r) if rooms and r else 0
            s -= abs(m2 - m) / max(m2, m) if m2 and m else 0
            if anchored:
                s -= abs(price - anchor) / anchor * 3
            scored.append((-s, pid))
        out[qid] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("anchored", [False, True])
@pytest.mark.parametrize("pool_size", [2, 40, 250])
def test_similar_equals_brute_force(spark, anchored, pool_size):
    # The small pools leave queries whose zone has too few comparables, so towns and the whole pool are searched.
    qs = listings(40, 11) + [(100, "nowhere", "t1", 2, 50.0, 9000.0), (101, None, None, None, None, 7000.0)]
    pool = listings(pool_size, 12)
    cols = "colonia STRING, municipio STRING, recamaras INT, m2 DOUBLE"
    q = spark.createDataFrame(qs, f"qid BIGINT, {cols}, anchor DOUBLE")
    p = spark.createDataFrame(pool, f"id BIGINT, {cols}, price DOUBLE")
    got = {}
    for r in retrieve.similar(q, p, 3, anchored).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    want = brute_similar(qs, pool, 3, anchored)
    for qid, rows_ in want.items():
        mine = sorted(got[qid])
        assert [s for _, _, s in mine] == pytest.approx([-s for s, _ in rows_])
        assert len(mine) == min(3, pool_size)
        if not anchored:
            assert [i for _, i, _ in mine] == [i for _, i in rows_]


def test_bm25_equals_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["the"] * (3 if i % 3 else 1) + rnd.choices(vocab, k=rnd.randint(1, 30)))) for i in range(120)]
    qs = [(i, " ".join(["the"] + rnd.choices(vocab, k=5) + ["unseen"])) for i in range(12)]
    q, d = spark.createDataFrame(qs, "qid BIGINT, text STRING"), spark.createDataFrame(docs, "id BIGINT, text STRING")
    toks = {i: t.split() for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(toks) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    for seeds in (10, 100_000):
        got = {}
        for r in retrieve.bm25_topk(q, d, 5, seed_postings=seeds).collect():
            got.setdefault(r.qid, {})[r["rank"]] = (r.id, r.score)
        for qid, text in qs:
            s = {}
            for i, t in toks.items():
                s[i] = sum((raw[w] if raw[w] >= 0 else eps) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split() if w in t)
            best = sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
            assert [got[qid][j + 1][0] for j in range(5)] == [i for i, _ in best]


@pytest.mark.parametrize("block", [7, 4096])
def test_cosine_equals_brute_force(spark, block):
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(5, 8)) * 4
    x = centers[np.where(np.arange(150) % 3 == 0, 0, np.arange(150) % 5)] + rnd.normal(size=(150, 8))
    x[10] = x[20] = x[30]  # equal vectors: the smaller id comes first
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id BIGINT, vec ARRAY<FLOAT>")
    got = {}
    for r in retrieve.cosine_topk(df.withColumnRenamed("id", "qid"), df, 4, exclude_self=True, pivots=6, block=block).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    f = x.astype("float32").astype("float64")
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    s = np.floor(u @ u.T * 1e9 + 0.50001) / 1e9
    for i in range(150):
        want = [j for j in sorted(range(150), key=lambda j: (-s[i, j], j)) if j != i][:4]
        assert [got[i][r] for r in (1, 2, 3, 4)] == want


def test_mcnemar_published_values():
    # --- fixed values: published discordant counts and p-values ---
    cases = [(28, 17, 0.13603712811414326), (37, 12, 0.0006067668456360975), (19, 5, 0.00796348920654999),
             (34, 15, 0.01012799054939062), (42, 11, 3.775313521670043e-05), (20, 8, 0.03763531378731433)]
    for n01, n10, p in cases:
        assert evaluate.chi2_sf1((abs(n01 - n10) - 1) ** 2 / (n01 + n10)) == pytest.approx(p, rel=1e-9)


def test_student_tail_published_values():
    for t, p in ((-1.154, 0.2498), (-1.59, 0.1133), (0.005, 0.9963)):
        # The published t has three decimals, which moves p by up to 4e-4.
        assert evaluate.t_sf2(t, 217) == pytest.approx(p, abs=5e-4)
    assert evaluate.t_sf2(2.0, 1e9) == pytest.approx(evaluate.normal_sf2(2.0), rel=1e-6)


def test_wilcoxon_small_sample(spark):
    a = [1.0, 4.0, 3.0, 9.0, 5.0, 6.0, 2.0]
    b = [2.0, 2.0, 3.0, 5.0, 8.0, 6.5, 4.0]
    got = evaluate.wilcoxon(spark.createDataFrame(list(zip(a, b)), "a DOUBLE, b DOUBLE"), "a", "b").first()
    d = [x - y for x, y in zip(a, b) if x != y]
    av = sorted(abs(x) for x in d)
    rank = {v: np.mean([i + 1 for i, w in enumerate(av) if w == v]) for v in av}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    minus = sum(rank[abs(x)] for x in d if x < 0)
    assert (got.n, got.w) == (6, min(plus, minus))


def test_errors_of_missing_and_zero_prices(spark):
    df = spark.createDataFrame([(None, 100.0), (0.0, 100.0), (100.0, 100.0), (50.0, 0.0)], "p DOUBLE, r DOUBLE").coalesce(1)
    assert [r[0] for r in df.select(evaluate.error_pct("p", "r")).collect()] == [None, None, 0.0, None]
    assert [r[0] for r in df.select(evaluate.error_pct("p", "r", 100.0)).collect()] == [100.0, 100.0, 0.0, None]
    acc = evaluate.accuracy(df.withColumn("err", evaluate.error_pct("p", "r")), []).first()
    assert (acc.n, acc.acc_15) == (1, 100.0)


def test_threshold_accuracy(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", " ", 0.9), ("b", "y", 0.33)], "kind STRING, answer STRING, score DOUBLE")
    got = {r.kind: (r.accuracy, r.n) for r in evaluate.threshold_accuracy(df, "kind", "answer", "score").collect()}
    assert got["a"] == (100.0, 1) and got["b"] == (0.0, 1) and got["TOTAL"] == (pytest.approx(100 / 3), 3)


def test_bootstrap_interval_covers_the_mean(spark):
    rnd = random.Random(9)
    vals = [rnd.gauss(50, 10) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(vals)), "id INT, v DOUBLE")
    got = sampling.bootstrap_ci(df, "id", "v", 200).first()
    mean, se = np.mean(vals), np.std(vals) / 20
    assert got.n == 200 and mean - 3 * se < got.lo < mean < got.hi < mean + 3 * se


def test_splits_cover_everything_once(spark):
    df = spark.range(5000)
    shares = {r.s: r.n / 5000 for r in df.groupBy(sampling.split3("id", 1).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert shares == pytest.approx({"train": 0.8, "valid": 0.1, "test": 0.1}, abs=0.02)
    assert sorted(r.id_seq for r in sampling.renumber(df, "id", 3).collect()) == list(range(1, 5001))
    sub = sampling.nested_subsets(df, "id", [10, 50], 3).collect()
    small = {r.id for r in sub if r.size == 10}
    assert len(small) == 10 and small <= {r.id for r in sub if r.size == 50}


def test_histogram_and_constant_column(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]], "x DOUBLE")
    assert {r.bin: r.n for r in aggregate.histogram(df, "x", 5).collect()} == {0: 2, 1: 2, 4: 1}
    assert [(r.bin, r.n) for r in aggregate.histogram(df.withColumn("x", F.lit(1.0)), "x", 5).collect()] == [(0, 5)]


def test_stream_merge_equals_batch_and_survives_a_repeat(spark, tmp_path):
    base = [(i, f"u{i % 40}", float(i % 7), "2024-01-01") for i in range(120)]
    df = spark.createDataFrame(base, "listing_id BIGINT, source_url STRING, price DOUBLE, d STRING").select(
        "listing_id", "source_url", "price", F.to_timestamp("d").alias("seen"))
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(5).write.parquet(src)
    for _ in range(2):  # the second run has lost its progress and reads everything again
        incremental.stream_merge(spark, incremental.file_stream(spark, src, df.schema), dst, "source_url")
        got = [r.source_url for r in incremental.read_batches(spark, dst, df.schema).collect()]
        assert sorted(got) == sorted({u for _, u, _, _ in base})


def test_weekly_merge_prefers_the_base(spark):
    base = spark.createDataFrame([(1, "u1", 10.0), (2, None, 5.0)], "listing_id INT, source_url STRING, price DOUBLE")
    new = spark.createDataFrame([(3, "u1", 99.0, "x"), (4, "u2", 0.0, "x"), (5, None, 7.0, "x"), (6, "u3", 8.0, "x")], "listing_id INT, source_url STRING, price DOUBLE, extra STRING")
    got = sorted((r.listing_id, r.price, r.extra) for r in incremental.weekly_merge(base, new).collect())
    assert got == [(1, 10.0, None), (2, 5.0, None), (6, 8.0, "x")]


def test_interval_overlap(spark):
    cis = spark.createDataFrame([("a", 0.0, 2.0), ("b", 1.0, 3.0), ("c", 2.5, 4.0)], "model STRING, lo DOUBLE, hi DOUBLE")
    got = {(r.a, r.b): r.overlap for r in evaluate.ci_overlap(cis).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("b", "c"): True} and len(got) == len(list(combinations("abc", 2)))


def test_training_log(spark, tmp_path):
    from valora.sources.files import parse_training_log

    (tmp_path / "log.txt").write_text("Loading\nIter 1: Val loss 3.25, Val took 2s\nIter 10: Train loss 1.5, Learning Rate 1e-5\nDone\n")
    got = sorted((r.iter, r.series, r.loss) for r in parse_training_log(spark, str(tmp_path)).collect())
    assert got == [(1, "val", 3.25), (10, "train", 1.5)]


def test_stream_merge_keeps_earlier_runs(spark, tmp_path):
    import shutil

    schema, dst = "source_url string, seen timestamp, price double", str(tmp_path / "dst")
    wanted = []
    for k, urls in enumerate((["a", "b"], ["c"], ["b", "d"], ["a", "e"])):
        src = str(tmp_path / f"src{k}")
        spark.createDataFrame([(u, datetime.datetime(2024, 1, 1 + k), 1.0) for u in urls], schema).write.parquet(src)
        if k == 3:  # as if all progress were lost
            shutil.rmtree(f"{dst}/_progress")
        incremental.stream_merge(spark, incremental.file_stream(spark, src, spark.read.parquet(src).schema), dst, "source_url", name=f"src{k}")
        wanted = sorted({*wanted, *urls})
        got = incremental.read_batches(spark, dst, spark.read.parquet(src).schema)
        assert sorted(r.source_url for r in got.collect()) == wanted


def test_vectors_in_small_tiles(spark, monkeypatch):
    """Tiles of 3 questions and 5 visits give the same as brute force."""
    monkeypatch.setattr(retrieve, "TILE", 3)
    monkeypatch.setattr(retrieve, "SENT", 5)
    v = np.random.default_rng(8).normal(size=(60, 6))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id BIGINT, vec ARRAY<DOUBLE>")
    got = retrieve.cosine_topk(df.withColumnRenamed("id", "qid"), df, 4, exclude_self=True, pivots=5, block=16).collect()
    want = {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.argsort(-sims[i], kind="stable")[:4])}
    assert {(r.qid, r["rank"]): r.id for r in got} == want
