"""Connected components of a link table by alternating stars, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    ``component`` is the smallest node reachable. Loops and links with a null end count for nothing, and
    repeated links once. Each round hooks every node to its smallest neighbour (a combined minimum, then an
    equality join, so that the links of a hot node are split over tasks) and is written to the shared
    folder. It ends when a round changes nothing: all components are stars then.
    """
    now = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links",
    )
    seen = _state(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, seen = seen, _state(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
