"""Near-duplicate vectors by an exact metric range join.

Cosine >= t on unit vectors is a Euclidean distance <= r = sqrt(2 - 2t). Every distinct vector has a home
cell, that of its nearest pivot, and visits each other cell where a partner could live: by the triangle
inequality only cells c with d(x, c) <= d(x, home) + 2r and d(x, c) <= radius(c) + r. All partners of a
vector are thus in its home cell, which is searched on its own, in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize
from valora.llm.components import connected_components

SLACK = 1e-9  # widens every pruning test, never the link test


def unit_rows(vectors) -> np.ndarray:
    """Unit rows in double precision, scaled first so that no square overflows."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def choose_pivots(sample: list, wanted: int) -> dict[int, np.ndarray]:
    """By dimension, up to ``wanted`` sample vectors, each the farthest from those chosen before."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        rows = unit_rows([v for v in sample if len(v) == dim])
        chosen, far = [0], np.linalg.norm(rows - rows[0], axis=1)
        while len(chosen) < wanted and far.max() > SLACK:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        out[dim] = rows[chosen]
    return out


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * rows @ pivots.T))


def link_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    tile_rows: int = 2048, max_pivots: int = 256,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is at
    least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null id, link with nothing: n_links 0, their own component (null for a null id), kept. Each
    repeated row counts as one vector. Other columns are ignored. Copies are compared once and counted by
    their number. ``max_pivots`` bounds what is broadcast; a cell beyond ``tile_rows`` is cut into tiles.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False),
    )
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable")
    distinct = materialize(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "vectors")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    wanted = max(1, min(max_pivots, math.ceil(largest / tile_rows)))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(4 * wanted).select("vec").collect()
    pivots = choose_pivots([r[0] for r in sample], wanted)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))

    def by_dim(pdf: pd.DataFrame):
        dims = pdf["vec"].map(len).to_numpy()
        for dim in np.unique(dims):
            part = pdf[dims == dim]
            units = unit_rows(part["vec"])
            yield int(dim), part, pivot_distances(units, pivots.get(int(dim), units[:1] * 0))

    def homes(batches):
        for pdf in batches:
            for dim, part, far in by_dim(pdf) if len(pdf) else ():
                yield part.assign(dim=dim, home=far.argmin(axis=1).astype(np.int32), far=far.min(axis=1))

    assigned = materialize(distinct.mapInPandas(homes, distinct.select(
        "*", F.lit(0).alias("dim"), F.lit(0).alias("home"), F.lit(0.0).alias("far")).schema), "vectors")
    radius = {(r.dim, r.home): r.far for r in assigned.groupBy("dim", "home").agg(F.max("far").alias("far")).collect()}

    def visits(part: pd.DataFrame, dim: int, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rad = np.array([radius.get((dim, c), -np.inf) for c in range(far.shape[1])])
        own = part["far"].to_numpy()[:, None]
        return np.nonzero((far <= own + 2 * reach + SLACK) & (far <= rad + reach + SLACK))

    def members(batches):
        for pdf in batches:
            for dim, part, far in by_dim(pdf) if len(pdf) else ():
                at, cell = visits(part, dim, far)
                out = part.iloc[at].assign(cell=cell.astype(np.int32))
                yield out.assign(is_home=out["cell"] == out["home"]).drop(columns=["home", "far"])

    def sizes(batches):
        for pdf in batches:
            for dim, part, far in by_dim(pdf) if len(pdf) else ():
                at, cell = visits(part, dim, far)
                yield pd.DataFrame({"label": part["label"].to_numpy()[at], "dim": dim, "cell": cell}).groupby(
                    ["label", "dim", "cell"]).size().reset_index(name="n")

    label_type = distinct.schema["label"].dataType.simpleString()
    vec_type = distinct.schema["vec"].dataType.simpleString()
    id_type = distinct.schema["rep"].dataType.simpleString()
    blocks = lambda n: F.ceil(F.col(n) / F.lit(tile_rows)).cast("int")
    cells = assigned.select("label", "dim", F.col("home").alias("cell")).groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    visited = assigned.mapInPandas(sizes, f"label {label_type}, dim int, cell int, n long").groupBy("label", "dim", "cell").agg(F.sum("n").alias("n"))
    grid = materialize(cells.select("label", "dim", "cell", blocks("n").alias("home_blocks")).join(
        visited.select("label", "dim", "cell", blocks("n").alias("blocks")), ["label", "dim", "cell"]), "cells")
    spread = assigned.mapInPandas(members, f"label {label_type}, vec {vec_type}, rep {id_type}, mult long, dim int, cell int, is_home boolean")
    spread = spread.join(grid, ["label", "dim", "cell"])
    home_block = F.pmod(F.xxhash64("rep"), F.col("home_blocks")).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    as_home = spread.where("is_home").withColumn("hb", home_block).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    as_member = spread.withColumn("mb", block).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)))
    keys = ["label", "dim", "cell", "hb", "mb"]
    tiles = as_home.select(*keys, "rep", "mult", "vec", F.lit(True).alias("asks")).unionByName(
        as_member.select(*keys, "rep", "mult", "vec", F.lit(False).alias("asks")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        mine, theirs = pdf[asks], pdf[~asks]
        if mine.empty or theirs.empty:
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        own, other = mine["rep"].to_numpy(), theirs["rep"].to_numpy()
        close = unit_rows(mine["vec"]) @ unit_rows(theirs["vec"]).T >= threshold
        same = own[:, None] == other[None, :]
        links = (close & ~same) @ theirs["mult"].to_numpy()
        close |= same
        top_own, top_other = own.copy(), other.copy()
        high = np.iinfo(np.int64).max
        while True:
            down = np.minimum(top_other, np.where(close, top_own[:, None], high).min(axis=0))
            up = np.minimum(top_own, np.where(close, down[None, :], high).min(axis=1))
            if np.array_equal(up, top_own) and np.array_equal(down, top_other):
                break
            top_own, top_other = up, down
        joined = close.any(axis=0)
        return pd.DataFrame({
            "rep": np.concatenate([own, other[joined]]), "links": np.concatenate([links, np.zeros(joined.sum(), np.int64)]),
            "root": np.concatenate([top_own, top_other[joined]]),
        })

    found = materialize(tiles.groupBy(*keys).applyInPandas(search, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = distinct.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("id", "label", "vec").join(told, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
