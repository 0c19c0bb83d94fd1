"""Segments, lead rankings and valuation flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import col
from valora.functions.rules import PROFILES, Rule, score
from valora.operators.ordering import top_k
from valora.operators.quantile import exact_quantiles


def with_scores(df: DataFrame, profiles: Mapping[str, Sequence[Rule]] = PROFILES) -> DataFrame:
    return df.select("*", *[score(r).alias(f"score_{n}") for n, r in profiles.items()])


def scores_long(df: DataFrame, keep: Sequence[str], profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    items = F.array(*[F.struct(F.lit(p).alias("segment"), F.col(f"score_{p}").alias("score")) for p in profiles])
    return df.select(*keep, F.explode(items).alias("__s")).select(*keep, "__s.segment", "__s.score")


def ranking(df: DataFrame, key: str, n: int, keep: Sequence[str] = (), profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    """Top ``n`` leads of every profile in one pass; ties go to the smaller key."""
    long = scores_long(df, [key, *keep], profiles)
    return top_k(long, ["segment"], [F.desc("score"), F.col(key)], n, "rank")


def best_segment(df: DataFrame, profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    return df.withColumn("best_score", F.greatest(*[F.col(f"score_{p}") for p in profiles]))


def segment_summary(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Rows, best score, median price and leads with a phone per segment."""
    med = exact_quantiles(df, [segment], "price", {"median_price": 0.5}).drop("n")
    stats = df.groupBy(segment).agg(
        F.count("*").alias("n"), F.max("score").alias("max_score"), F.count("phone").alias("with_phone")
    )
    return stats.join(med, segment)


def valuation_flags(df: DataFrame, price: str = "price", estimate: str = "estimate", pct: float = 20.0) -> DataFrame:
    diff = (col(price) - col(estimate)) / col(estimate) * 100
    return df.withColumn("diff_pct", diff).withColumn("over", F.col("diff_pct") > pct).withColumn("under", F.col("diff_pct") < -pct)


def cluster_tags(profile: DataFrame, df: DataFrame, price: str, flags: Sequence[str]) -> DataFrame:
    """Words for each cluster from its mean profile against the overall median."""
    med = exact_quantiles(df, [], price, {"m": 0.5}).select("m").scalar()
    return profile.withColumn(
        "tags",
        F.concat_ws(
            ", ",
            F.when(F.col(price) > med * 1.2, "precio alto").otherwise("precio bajo"),
            *[F.when(F.col(f) > 0.5, f) for f in flags],
        ),
    )


def candidates(df: DataFrame, segment: str, views: str, key: str, n: int) -> DataFrame:
    """Most viewed listings of each segment."""
    return top_k(df, [segment], [F.col(views).desc_nulls_last(), F.col(key)], n, "rank")


def stop_after_goal(ranked: DataFrame, segment: str, rank: str, valid: str, goal: int) -> DataFrame:
    """The attempted rows when walking ranked candidates until ``goal`` successes.

    The candidates of a segment are already cut to a fixed number, so the window is small.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(segment).orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(valid).cast("int")).over(w), F.lit(0))
    return ranked.withColumn("found_before", before.cast("bigint")).filter(F.col("found_before") < goal)
