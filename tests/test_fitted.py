"""Registered queries without a SQL twin against plain numpy on the same rows."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.operators import segment
from valora.plans.catalog import QUERIES
from valora.plans.catalog_models import _CLUSTER, FEATURES, prepared
from valora.plans.registry import Context


def test_qq_points(spark, sf_dir):
    rows = Context(spark, sf_dir).prediction.where("model = 'a' AND precio_predicho IS NOT NULL").toPandas()
    rows = sorted((a - p, i) for a, p, i in zip(rows.precio_real, rows.precio_predicho, rows.id))
    n = len(rows)
    share = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    q = np.array([NormalDist().inv_cdf(p) for p in share])
    res = np.array([r for r, _ in rows])
    slope, intercept = np.polyfit(q, res, 1)
    got = QUERIES["g9_qq_points"](spark, sf_dir).orderBy("i").collect()
    assert [r.id for r in got] == [i for _, i in rows] and [r.i for r in got] == list(range(1, n + 1))
    assert [r.q for r in got] == pytest.approx(list(q), abs=2e-6)
    assert [r.res for r in got] == pytest.approx(list(res), abs=1e-3)
    assert [r.fitted for r in got] == pytest.approx(list(slope * q + intercept), abs=0.05)


def test_principal_components(spark, sf_dir):
    rows = Context(spark, sf_dir).listing.select("listing_id", *_CLUSTER).dropna().toPandas().sort_values("listing_id")
    x = rows[_CLUSTER].astype(float).to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    got = QUERIES["k25_principal_components"](spark, sf_dir).toPandas().sort_values("listing_id")
    assert list(got.listing_id) == list(rows.listing_id)
    for k, name in enumerate(["pc1", "pc2"]):
        want, have = z @ axes[k], got[name].to_numpy()
        assert np.abs(have - np.sign(want @ have) * want).max() < 1e-5  # an axis has no sign


def test_scored_listings(spark, sf_dir):
    rows = prepared(Context(spark, sf_dir), "train").select("listing_id", "price", "label", "split", *[F.col(f).cast("double").alias(f) for f in FEATURES]).toPandas()
    train = rows[rows.split == "train"]
    medians = train[FEATURES].median()
    design = lambda r: np.column_stack([np.ones(len(r)), r[FEATURES].fillna(medians).to_numpy()])
    beta = np.linalg.lstsq(design(train), train.label.to_numpy(), rcond=None)[0]
    rows["want"] = np.expm1(design(rows) @ beta)
    got = QUERIES["k22_score_listings"](spark, sf_dir).toPandas().merge(rows, on="listing_id")
    assert len(got) == len(rows)
    assert got.estimate.to_numpy() == pytest.approx(got.want.to_numpy(), rel=1e-4)
    diff = (got.price - got.want) / got.want * 100
    clear = (diff.abs() - 20).abs() > 0.05
    assert ((diff > 20) == got.over)[clear].all() and ((diff < -20) == got.under)[clear].all()


def test_flags_at_the_bound(spark):
    rows = spark.createDataFrame([(120.0, 100.0), (121.0, 100.0), (80.0, 100.0), (79.0, 100.0), (None, 100.0)], "price double, estimate double")
    got = segment.valuation_flags(rows).collect()
    assert [(r.over, r.under) for r in got] == [(False, False), (True, False), (False, False), (False, True), (None, None)]
