"""Approximate largest inner products by an adaptive scan of dimensions inside probed lists.

Vectors are scaled below the length 1 and get one more component that makes it 1: the largest inner product with
a unit query is then the smallest distance to it. A random rotation spreads the length over all components, so
the distance over the first few, scaled up, estimates the whole one. The index cuts the vectors into lists by
nearest centroid and stores each list in tiles, rotated, in blocks of columns. A search reads the blocks of a
probed tile one by one and abandons a candidate as soon as a test rejects that its whole distance is below
the k-th best known so far; what is left is scored exactly on the original vectors.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valora.llm.common import materialize

EPSILON = 2.1  # of the test: larger abandons later
PAIRS = 1 << 15  # candidates measured at a time
QUERIES = 256  # queries scanned together


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over ``longest``, and the component that makes their length 1."""
    x = vectors / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def directions(queries: np.ndarray) -> np.ndarray:
    """Queries of length 1, and a zero."""
    return np.concatenate([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))], axis=1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)


def fit_lists(sample: np.ndarray, queries: np.ndarray, wanted: int, k: int, recall: float, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Centroids of ``sample`` (lifted), and how many of the nearest lists a query must probe to find the share
    ``recall`` of its k nearest rows in the sample."""
    rng = np.random.default_rng(len(sample))
    centres = sample[np.sort(rng.choice(len(sample), min(wanted, len(sample)), replace=False))]
    for _ in range(rounds):
        home = _squared(sample, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        count = np.bincount(home, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    home = _squared(sample, centres).argmin(axis=1)
    k = min(k, len(sample))
    nearest = np.argpartition(_squared(queries, sample), k - 1, axis=1)[:, :k]
    order = _squared(queries, centres).argsort(axis=1).argsort(axis=1)  # place of each list for each query
    places = np.sort(order[np.arange(len(queries))[:, None], home[nearest]].reshape(-1))
    return centres, int(places[max(0, math.ceil(recall * len(places)) - 1)]) + 1


def scan_tile(blocks: list[np.ndarray], originals: np.ndarray, rotated: np.ndarray, queries: np.ndarray, best: np.ndarray, longest: float, k: int):
    """(query, row, score) of the pairs that may be among the k best of a query; ``best`` is its k-th score so far."""
    cuts = np.cumsum([0] + [b.shape[1] for b in blocks])
    dim, norms = cuts[-1], np.linalg.norm(queries, axis=1)
    squared = lambda score: np.maximum(0.0, 2 - 2 * score / (norms * longest))
    score = lambda q, x: np.einsum("ij,ij->i", queries[q], originals[x])
    limit = np.where(np.isnan(best), np.inf, squared(np.nan_to_num(best)))
    partial = _squared(rotated[:, :cuts[1]], blocks[0])
    if partial.shape[1] >= k and np.isinf(limit).any():
        # The exact scores of the k rows that look nearest bound the k-th best.
        rows = np.nonzero(np.isinf(limit))[0]
        near = np.argpartition(partial[rows], k - 1, axis=1)[:, :k]
        kth = np.array([score(np.full(k, q), x).min() for q, x in zip(rows, near)])
        limit[rows] = squared(_spread(best, rows, kth))[rows]
    # Rounding must never decide: the limit is a little wider than the distance it stands for.
    limit = limit * (1 + 1e-5) + 1e-5
    widened = lambda d: limit * (1 + EPSILON / math.sqrt(d)) ** 2 * d / dim if d < dim else limit
    q, x = np.nonzero(partial <= widened(cuts[1])[:, None])
    far = partial[q, x]
    for b, (lo, hi) in enumerate(zip(cuts[1:], cuts[2:]), 1):
        for at in range(0, len(q), PAIRS):
            s = slice(at, at + PAIRS)
            gap = rotated[q[s], lo:hi] - blocks[b][x[s]]
            far[s] += np.einsum("ij,ij->i", gap, gap)
        stays = far <= widened(hi)[q]
        q, x, far = q[stays], x[stays], far[stays]
    found = [score(q[at:at + PAIRS], x[at:at + PAIRS]) for at in range(0, len(q), PAIRS)]
    return q, x, np.concatenate([np.zeros(0), *found])


def _spread(best: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(best)
    out[rows] = values
    return out


def _first_of_each(q: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by score, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -score, q))
    start = np.searchsorted(q[order], q[order], side="left")
    return order[np.arange(len(order)) - start < k]


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    sample_rows: int = 8192, list_rows: int = 512, max_lists: int = 1024, recall: float = 0.98, tile_values: int = 1 << 18, block: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of largest inner product that were found, the query's own id excepted.

    Every vector is indexed. The lists, and the number of them that a query probes, are fitted on at most
    ``sample_rows`` vectors and 256 queries, so that the share ``recall`` of the nearest rows in the sample
    lies in the probed lists; results are approximate, scores exact. Ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components, or whose squared length is not finite in double
    precision, and rows with a null id take no part; vectors of different lengths are never compared. Copies
    are searched once: equal vectors keep the k + 1 smallest ids, which is all that a result can hold of them.
    Repeated rows count once. Where fewer than k rows were found, all of them are returned. Ids are integers.
    Other columns are ignored.
    """
    dims = lambda c: F.size(c)
    mine = _usable(vectors, id_col, vec_col)
    by_id = W.partitionBy("vec").orderBy("id")
    few = mine.withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1)
    distinct = materialize(few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(
        "vec", "ids", F.get("ids", 0).alias("rep"), dims("vec").alias("dim")), "vectors")
    asking = _usable(queries, id_col, vec_col).distinct()
    asked = materialize(asking.groupBy("vec").agg(F.min("id").alias("qid")).withColumn("dim", dims("vec")), "queries")

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = {r.dim: (r.n, r.longest) for r in distinct.groupBy("dim").agg(F.count("*").alias("n"), F.max(length).alias("longest")).collect()}
    take = lambda df, key, n: df.orderBy(F.xxhash64(key), key).limit(n).select("vec", "dim").toPandas()
    some, probes_by = take(distinct, "rep", sample_rows), take(asked, "qid", QUERIES)
    lists: dict[int, tuple[np.ndarray, int]] = {}
    for dim, (n, longest) in facts.items():
        rows, ask = some["vec"][some["dim"] == dim], probes_by["vec"][probes_by["dim"] == dim]
        wanted = min(max_lists, math.ceil(n / list_rows))
        if wanted > 1 and len(rows) and len(ask):
            lists[dim] = fit_lists(lifted(_matrix(rows), longest), directions(_matrix(ask)), wanted, k + 1, recall)
        else:
            lists[dim] = np.zeros((1, dim + 1)), 1

    def by_dim(pdf: pd.DataFrame):
        for dim, part in pdf.groupby("dim"):
            if dim in lists:
                yield int(dim), part, *lists[dim]

    def homes(batches):
        for pdf in batches:
            for dim, part, centres, _ in by_dim(pdf):
                yield part.assign(list=_squared(lifted(_matrix(part["vec"]), facts[dim][1]), centres).argmin(axis=1).astype(np.int32))

    def probed(batches):
        for pdf in batches:
            for _, part, centres, n in by_dim(pdf):
                order = np.argsort(_squared(directions(_matrix(part["vec"])), centres), axis=1, kind="stable")[:, :n]
                out = part.loc[part.index.repeat(order.shape[1])]
                yield out.assign(list=order.reshape(-1).astype(np.int32), turn=np.tile(np.arange(order.shape[1], dtype=np.int32), len(part)))

    types = {f.name: f.dataType.simpleString() for f in [*distinct.schema.fields, *asked.schema.fields]}
    kinds = lambda df: ", ".join(f"{c} {types[c]}" for c in df.columns)
    placed = materialize(distinct.mapInPandas(homes, f"{kinds(distinct)}, list int"), "vectors")
    tile_rows = F.greatest(F.lit(64), F.least(F.lit(2048), F.floor(F.lit(tile_values) / F.col("dim"))))
    sizes = materialize(placed.groupBy("dim", "list").agg(F.ceil(F.count("*") / F.first(tile_rows)).cast("int").alias("tiles")), "lists")
    tiled = placed.join(sizes, ["dim", "list"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iat[0])
        rows = _matrix(pdf["vec"])
        turned = (lifted(rows, facts[dim][1]) @ rotation(dim + 1)).astype(np.float32)
        return pd.DataFrame({
            "dim": [dim], "list": [pdf["list"].iat[0]], "tile": [pdf["tile"].iat[0]], "rows": [rows.tobytes()],
            "ids": [np.concatenate(pdf["ids"].tolist()).astype(np.int64).tobytes()], "copies": [pdf["ids"].map(len).to_numpy(np.int32).tobytes()],
            "blocks": [[turned[:, i:i + block].tobytes() for i in range(0, dim + 1, block)]],
        })

    index = materialize(tiled.groupBy("dim", "list", "tile").applyInPandas(
        build, "dim int, list int, tile int, rows binary, ids binary, copies binary, blocks array<binary>"), "index")
    visits = materialize(asked.mapInPandas(probed, f"{kinds(asked)}, list int, turn int"), "visits")

    def search(key, tile: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(tile) and len(ask):
            dim, row = int(key[0]), tile.iloc[0]
            originals = np.frombuffer(row["rows"], dtype=np.float64).reshape(-1, dim)
            blocks = [np.frombuffer(b, dtype=np.float32).reshape(len(originals), -1) for b in row["blocks"]]
            copies = np.frombuffer(row["copies"], dtype=np.int32)
            ids, first = np.frombuffer(row["ids"], dtype=np.int64), np.cumsum(copies) - copies
            for at in range(0, len(ask), QUERIES):
                some = ask.iloc[at:at + QUERIES]
                mine = _matrix(some["vec"])
                turned = directions(mine) @ rotation(dim + 1)
                q, x, score = scan_tile(blocks, originals, turned, mine, some["best"].to_numpy(np.float64), facts[dim][1], k + 1)
                stays = _first_of_each(q, score, ids[first[x]], k + 1)
                q, x, score = q[stays], x[stays], score[stays]
                n = copies[x]
                place = np.repeat(first[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q, score, found = np.repeat(q, n), np.repeat(score, n), ids[place]
                stays = _first_of_each(q, score, found, k + 1)
                out.append(pd.DataFrame({"qid": some["qid"].to_numpy(np.int64)[q[stays]], "id": found[stays], "score": score[stays]}))
        return pd.concat(out)

    def searched(ask: DataFrame, per_group: int = 4096) -> DataFrame:
        """The k + 1 best of every query over the lists it visits; a group is one tile and about ``per_group`` queries."""
        crowd = ask.groupBy("dim", "list").agg(F.ceil(F.count("*") / per_group).cast("int").alias("shares"))
        grid = materialize(sizes.join(crowd, ["dim", "list"]), "grid")
        left = index.join(grid, ["dim", "list"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("tiles", "shares")
        right = ask.join(grid, ["dim", "list"]).withColumn("share", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int")).withColumn(
            "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("dim", "list", "tile", "share", "qid", "vec", "best")
        keys = ["dim", "list", "tile", "share"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "qid long, id long, score double")

    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    best_of = lambda df: df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    nearest = visits.where("turn = 0").withColumn("best", F.lit(None).cast("double"))
    one = materialize(best_of(searched(nearest)), "found")
    bounds = one.where(F.col("r") == k + 1).select("qid", F.col("score").alias("best"))
    two = materialize(searched(visits.where("turn > 0").join(bounds, "qid", "left")), "found")
    best = best_of(one.select("qid", "id", "score").unionByName(two))
    answers = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    answers = materialize(answers.join(asked.select("qid", "vec"), "qid").select("vec", "found"), "answers")
    told = asking.join(answers, "vec").select("id", F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"))
    return told.select(F.col("id").alias("query_id"), F.posexplode("found").alias("pos", "f")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("f.id").alias(id_col), F.col("f.score").alias("score"))


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    fine = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(fine & (square > 0) & (square < float("inf")))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
