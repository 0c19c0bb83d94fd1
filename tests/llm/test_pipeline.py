"""The pipeline's stages on a small corpus against brute force, and the optional subpackage."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from valora.llm.common import materialize
from valora.llm.simhash_trie import simhash

ROOT = Path(__file__).resolve().parents[2]


def test_every_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), "stage"))
    assert all(x.columns == columns for x in kept[:4])
    good, one, stripped = ({r.doc_id: r.text for r in x.collect()} for x in kept[1:4])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(i in good) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95
    prints = {i: simhash(t or "") for i, t in good.items()}
    want = {i for i in good if not any(bin(prints[i] ^ prints[j]).count("1") <= 3 for j in good if j < i)}
    assert want <= set(good) and set(one) <= want  # groups join through links, so no more than these stay
    assert {t for t in good.values()} >= set(one.values()) and len(set(one.values())) == len(one)
    assert set(stripped) == set(one) and all(len(stripped[i]) <= len(one[i]) for i in one)
    by = defaultdict(list)
    for r in kept[4].collect():
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        assert sum(n for _, n in spans) <= 2048 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    assert {r.doc_id for r in kept[4].select("doc_id").distinct().collect()} == set(stripped)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)
    odd = docs.withColumn("text", F.lit(None).cast("string")).unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for x in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            x = materialize(stage(spark, x, sf_dir), "stage")
        x.count()


def test_entry_works_without_the_subpackage():
    code = ("import sys; sys.modules['valora.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "names = e.queries(); assert len(names) > 200 and 'pipeline' not in names and not [n for n in names if n.startswith('op')]; assert e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
