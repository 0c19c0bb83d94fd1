"""Quality scores on held-out labels, and the shrinkage of sites by hand."""

import numpy as np
from pyspark.sql import functions as F, types as T

from valora.llm.site_quality import N_MEASURES, fit_logistic, measures, score_documents

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("_keep", T.StringType()), T.StructField("n", T.StringType()), T.StructField("s", T.StringType())])
LABELS = "doc_id long, quality int, text string"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    scored = score_documents(docs, labels.where(~held)).join(labels.where(held), "doc_id").select("_keep", "quality", "_score").collect()
    right = [r._keep == bool(r.quality) for r in scored]
    assert len(scored) > 150 and np.mean(right) >= 0.95
    assert np.mean([r._keep for r in scored if r.quality]) >= 0.97


def test_sparse_sites_shrink_and_bad_sites_sink(spark):
    good, bad = "A plain sentence about the river and its long banks.", "BUY!! NOW!! BUY!! NOW!! $$$ %%%"
    rows = [(i, good, "en", f"big{i % 5}", "x", "y", "z") for i in range(200)] + [(1000 + i, bad, "en", "spam", "x", "y", "z") for i in range(200)]
    rows += [(2000, bad, "en", "tiny", "x", "y", "z"), (2001, good, "en", "spam", "x", "y", "z"), (2002, good, "en", "big0", "x", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.where("doc_id < 1050").select("doc_id", F.col("doc_id").between(0, 999).cast("int").alias("quality"))
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert got[0]._keep and not got[1000]._keep and len(got) == len(rows)
    assert got[1000]._host < 0.1 < got[2000]._host < got[0]._host  # one document hardly moves its site
    assert got[2001]._score < got[2002]._score
    assert got[0].n == "y" and got[0].s == "z"


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None, None), (1, "", "en", None, None, None, None), (1, "", "en", None, None, None, None),
            (2, "long " * 30000, None, "s", None, None, None), (3, "Fine text here.", "en", "s", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], LABELS)
    got = score_documents(docs, none).collect()
    assert len(got) == 5 and {r._evidence for r in got} == {0.0} and all(r._keep for r in got)
    labels = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, ""), (2, 0, ""), (3, 1, ""), (3, None, ""), (9, 1, ""), (None, 1, "")], LABELS)
    got = score_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r._score <= 1 for r in got)
    assert score_documents(docs.where("false"), labels).count() == 0


def test_fit_and_measures():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 10, 0.1]
    y = (x @ [1, 0.2, -5] + 0.5 > 0).astype(float)
    bias, w = fit_logistic(x, y)
    assert np.mean((bias + x @ w > 0) == y) > 0.98
    for t in ("", " ", "a", "!!!", "é" * 10, "x\n" * 5000):
        assert len(measures(t)) == N_MEASURES and np.isfinite(measures(t)).all()


def test_posteriors_against_plain_numpy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = score_documents(docs, labels).toPandas()
    good = 1 / (1 + np.exp(-got["_evidence"].to_numpy()))
    overall = good.mean()

    def strength(groups):  # (size, mean, parent)
        n, mean, parent = (np.array(x, dtype=float) for x in zip(*[g for g in groups if g[0] > 1]))
        between = (n * ((mean - parent) ** 2 - parent * (1 - parent) / n)).sum()
        return 1e6 if between <= 0 else min(1e6, max(1.0, (n * parent * (1 - parent)).sum() / between - 1))

    hosts = {h: good[at] for h, at in got.groupby("source", dropna=False).indices.items()}
    k = strength([(len(x), x.mean(), overall) for x in hosts.values()])
    host = {h: (x.sum() + k * overall) / (len(x) + k) for h, x in hosts.items()}
    paths = {key: good[at] for key, at in got.groupby(["source", "lang"], dropna=False).indices.items()}
    k = strength([(len(x), x.mean(), host[key[0]]) for key, x in paths.items()])
    for r, g in zip(got.to_dict("records"), good):
        x, h = paths[r["source"], r["lang"]], host[r["source"]]
        assert abs(r["_host"] - h) < 1e-9 and abs(r["_path"] - (x.sum() + k * h) / (len(x) + k)) < 1e-9
        others = min(1 - 1e-6, max(1e-6, (max(x.sum() - g, 0) + k * h) / (len(x) - 1 + k)))
        odds = r["_evidence"] + np.log(others / (1 - others)) - np.log(overall / (1 - overall))
        assert abs(r["_score"] - 1 / (1 + np.exp(-odds))) < 1e-9 and r["_keep"] == (r["_score"] >= 0.5)
