"""Approximate vector search: random-projection buckets, several tables, several buckets probed in each.

The side of a random plane on which a vector lies is one bit of its bucket; vectors at a small angle share most
bits. A query looks into its own bucket of each table and into those behind the planes it lies nearest to.
Only vectors met there are compared, with the exact cosine, in tiles of bounded size. For exact results use
:func:`valora.operators.retrieve.cosine_topk`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valora.operators.ordering import top_k
from valora.session import materialize

SEED = 20
MAX_BITS = 24
SENT = 4096  # visits sent at once


def planes(table: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, dim]).normal(size=(bits, dim))


def probe_order(margins: np.ndarray, probes: int) -> np.ndarray:
    """For each row the ``probes`` sets of bits to flip, cheapest first, as masks; a set costs its squared margins.

    Sets are taken from the few bits nearest to their planes, so that every row weighs the same sets.
    """
    bits = margins.shape[1]
    few = min(bits, max(1, math.ceil(math.log2(max(probes, 2))) + 2))
    near = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :few]
    sets = (np.arange(1 << few)[:, None] >> np.arange(few)) & 1
    cost = np.take_along_axis(margins, near, axis=1) ** 2 @ sets.T
    masks = (1 << near.astype(np.int64)) @ sets.T
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(masks, order, axis=1)


def approximate_cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 5, exclude_self: bool = False, tables: int = 8, probes: int = 8, bucket: int = 128, tile: int = 2048,
) -> DataFrame:
    """(qid, rank, id, sim): the most similar corpus vectors of every query (qid, vec) that were found in ``tables`` x ``probes`` buckets.

    APPROXIMATE: similarities are exact, but a neighbour that shares no probed bucket is missed; a query may
    get fewer than ``k`` rows. Buckets hold about ``bucket`` different vectors of (id, vec) on average; large ones
    are cut into tiles of at most about ``tile`` on both sides. Copies are searched once: equal vectors keep the
    k + 1 smallest ids, more than a result can hold of them. Ties go to the smaller id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part; different lengths never meet.
    """
    need = k + 1
    by_id = W.partitionBy("v").orderBy("id")
    few = _units(corpus, "id").withColumn("r", F.dense_rank().over(by_id)).filter(F.col("r") <= need)
    base = few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("rep", F.get("ids", 0))
    base = materialize(base, "vectors")
    asking = _units(queries, "qid")
    asked = materialize(asking.groupBy("v").agg(F.min("qid").alias("q")), "questions")
    bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, base.count()) / bucket)))) if base.head(1) else 0

    def codes(pdf: pd.DataFrame, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Table, rows and the first ``n`` buckets of each."""
        sizes = pdf["v"].map(len).to_numpy()
        for dim in np.unique(sizes):
            rows = np.nonzero(sizes == dim)[0]
            vectors = np.stack(pdf["v"].to_numpy()[rows])
            for table in range(tables):
                margins = vectors @ planes(table, bits, int(dim)).T
                own = (margins > 0) @ (1 << np.arange(bits, dtype=np.int64))
                # Lengths never share a bucket.
                yield table, rows, (own[:, None] ^ probe_order(margins, n) if bits else own[:, None]) | int(dim) << MAX_BITS

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for table, rows, found in codes(pdf, 1) if len(pdf) else ():
                yield pdf.iloc[rows].assign(t=np.int32(table), code=found[:, 0])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for table, rows, found in codes(pdf, probes) if len(pdf) else ():
                # A question takes its vector along to every bucket.
                who, code = np.repeat(rows, found.shape[1]), found.reshape(-1)
                for at in range(0, len(who), SENT):
                    yield pdf.iloc[who[at:at + SENT]].assign(t=np.int32(table), code=code[at:at + SENT])

    cell = ["t", "code"]
    placed = materialize(base.mapInPandas(place, "v array<double>, ids array<bigint>, rep bigint, t int, code bigint"), "buckets")
    visits = materialize(asked.mapInPandas(visit, "v array<double>, q bigint, t int, code bigint"), "visits")
    tiles = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / tile).alias(name))
    grid = materialize(tiles(placed, "right_tiles").join(tiles(visits, "left_tiles"), cell), "grid")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = visits.join(grid, cell).withColumn("a", F.pmod(F.xxhash64("q"), F.col("left_tiles"))).withColumn("b", spread("right_tiles"))
    right = placed.join(grid, cell).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("right_tiles"))).withColumn("a", spread("left_tiles"))
    keys = [*cell, "a", "b"]

    def multiply(ask: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(met):
            return pd.DataFrame({"q": [], "rep": [], "ids": [], "sim": []})
        reps = met["rep"].to_numpy()
        order = np.argsort(reps)
        sims = np.floor(np.stack(ask["v"].to_numpy()) @ np.stack(met["v"].to_numpy())[order].T * 1e9 + 0.50001) / 1e9
        m = min(need, sims.shape[1])
        top = np.argsort(-sims, axis=1, kind="stable")[:, :m]
        at = order[top].reshape(-1)
        return pd.DataFrame({"q": np.repeat(ask["q"].to_numpy(), m), "rep": reps[at], "ids": met["ids"].to_numpy()[at], "sim": np.take_along_axis(sims, top, axis=1).reshape(-1)})

    found = left.select(*keys, "q", "v").groupBy(*keys).cogroup(right.select(*keys, "rep", "ids", "v").groupBy(*keys)).applyInPandas(
        multiply, "q bigint, rep bigint, ids array<bigint>, sim double")
    # The same vector can be met in several buckets.
    once = found.groupBy("q", "rep").agg(F.first("ids").alias("ids"), F.max("sim").alias("sim")).select("q", "sim", F.explode("ids").alias("id"))
    best = top_k(once, ["q"], [F.desc("sim"), F.col("id")], need, "r").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "sim"))).alias("found"))
    answers = materialize(best.join(asked, "q").select("v", "found"), "answers")
    others = F.filter("found", lambda f: f["id"] != F.col("qid")) if exclude_self else F.col("found")
    told = asking.join(answers, "v").select("qid", F.posexplode(F.slice(others, 1, k)).alias("pos", "f"))
    return told.select("qid", (F.col("pos") + 1).alias("rank"), F.col("f.id").alias("id"), F.col("f.sim").alias("sim"))


def _units(df: DataFrame, key: str) -> DataFrame:
    """(key, v): vectors of length one."""
    v = F.transform("vec", lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("bigint").alias(key), v.alias("v")).filter("v IS NOT NULL")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    # A null or non-finite component makes the sum null or non-finite.
    rows = rows.withColumn("n", F.sqrt(square)).filter((F.col("n") > 0) & (F.col("n") < float("inf")))
    return rows.select(key, F.transform("v", lambda x: x / F.col("n")).alias("v"))
