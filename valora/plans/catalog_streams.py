"""Queries that run streams to completion over files written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import half_up
from valora.operators import models, sampling
from valora.plans import jobs
from valora.plans.registry import Context, query, rnd
from valora.session import materialize, scratch_path
from valora.sources import pages
from valora.streaming import incremental


def arriving(c: Context) -> tuple[DataFrame, str]:
    """Listings as files that arrive in several batches, a third of them twice."""
    path = scratch_path(c.spark, "arrivals")
    rows = c.listing.select("listing_id", "source_url", "colonia", "price", "lujo", "recamaras", F.col("published").cast("timestamp").alias("seen"))
    again = rows.filter("listing_id % 3 = 0")
    rows.unionByName(again).repartition(6, "listing_id").write.parquet(path)
    return rows, path


@query("n2_stream_merge", f"SELECT listing_id, source_url, {rnd('price', 2)} AS price FROM listing", "listing")
def _(c: Context) -> DataFrame:
    rows, path = arriving(c)
    target = scratch_path(c.spark, "merged")
    incremental.stream_merge(c.spark, incremental.file_stream(c.spark, path, rows.schema), target, "source_url")
    got = incremental.read_batches(c.spark, target, rows.schema)
    return got.select("listing_id", "source_url", half_up("price", 2).alias("price"))


@query(
    "n3_incremental_enrich",
    """SELECT listing_id, CASE WHEN contains(lower(text), 'alberca') THEN 1 ELSE 0 END AS pool, recamaras AS bedrooms FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    """A third of the adverts come a second time, in later batches; the stream is stopped and restarted in between."""
    path, target = scratch_path(c.spark, "adverts"), scratch_path(c.spark, "enriched")
    rows = c.ad.select("listing_id", "text")

    def enrich(batch: DataFrame) -> DataFrame:
        got = jobs.enrich_listings(batch)
        return got.select("listing_id", F.array_contains("amenities", "alberca").cast("int").alias("pool"), "bedrooms")

    def arrive(some: DataFrame) -> None:
        some.repartition(4, "listing_id").write.mode("append").parquet(path)
        incremental.incremental_enrich(c.spark, incremental.file_stream(c.spark, path, rows.schema), enrich, target, "listing_id")

    arrive(rows.filter("listing_id % 2 = 0").unionByName(rows.filter("listing_id % 6 = 0")))
    arrive(rows.filter("listing_id % 2 = 1").unionByName(rows.filter("listing_id % 3 = 0")))
    return incremental.read_batches(c.spark, target, "listing_id BIGINT, pool INT, bedrooms INT")


_TENTH = "CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 10) AS INT)"


@query(
    "n5_market_pulse_stream",
    f"""WITH e AS (SELECT event_type, ts, value, CASE WHEN event_id % 10 = 0 THEN 9 ELSE {_TENTH} END AS part,
          TIMESTAMP '1970-01-01' + to_days(CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS INT) * 7) AS week FROM events),
        m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM e WHERE value IS NOT NULL GROUP BY part),
        f AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM e WHERE value IS NOT NULL)
        SELECT event_type, CAST(week AS DATE) AS week, {rnd('quantile_cont(value, 0.5)')} AS median, count(value) AS n FROM e JOIN m USING (part), f
        WHERE value IS NOT NULL AND (m.mark IS NULL OR week + INTERVAL 7 DAY > m.mark) AND week + INTERVAL 7 DAY <= f.mark GROUP BY 1, 2""",
)
def _(c: Context) -> DataFrame:
    """Events in order of time, ten days at a time; every tenth event comes last, mostly too late for its week."""
    path, target = scratch_path(c.spark, "events"), scratch_path(c.spark, "pulse")
    days = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 10).cast("int")
    rows = c.events.select(F.when(F.col("event_id") % 10 == 0, 9).otherwise(days).alias("part"), "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = materialize(rows, "events")
    # One row per part.
    for part in [r.part for r in rows.select("part").distinct().orderBy("part").collect()]:
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(path)
        stream = incremental.file_stream(c.spark, path, rows.drop("part").schema, 100_000)
        incremental.market_pulse_stream(c.spark, stream, target, "event_type", "ts", "value")
    got = incremental.read_batches(c.spark, target, "event_type STRING, week TIMESTAMP, median DOUBLE, n BIGINT")
    return got.select("event_type", F.col("week").cast("date").alias("week"), half_up("median").alias("median"), "n")


@query("n6_stream_scoring")
def _(c: Context) -> DataFrame:
    rows, path = arriving(c)
    names = ["lujo", "recamaras"]
    train = rows.withColumn("label", F.log1p("price")).withColumn("split", sampling.split2("listing_id", 42))
    model, saved = models.fit(train, names, models.linear(), "log1p", train=F.col("split") == "train"), scratch_path(c.spark, "model")
    models.save_model(model, c.spark, saved)
    target = scratch_path(c.spark, "scored")
    incremental.stream_score(c.spark, incremental.file_stream(c.spark, path, rows.schema), saved, target)
    got = incremental.read_batches(c.spark, target, "listing_id BIGINT, price DOUBLE, estimate DOUBLE, diff_pct DOUBLE, over BOOLEAN, under BOOLEAN")
    return got.select("listing_id", half_up("estimate", 2).alias("estimate"), half_up("diff_pct").alias("diff_pct"), "over", "under")


@query(
    "o3_cards_udtf",
    """SELECT CAST(floor(listing_id / 8) AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY floor(listing_id / 8) ORDER BY listing_id) - 1 AS INT) AS card_no,
       concat('Depto ', colonia) AS title, concat('/detalle/', listing_id) AS link FROM ad""",
    "ad",
)
def _(c: Context) -> DataFrame:
    from valora.plans.catalog_sources import card_pages

    return pages.cards_by_udtf(card_pages(c)).select("page_id", "card_no", "title", "link")


@query(
    "b_enrich_listings",
    """SELECT listing_id, bedrooms, owner FROM (SELECT listing_id, recamaras AS bedrooms,
        contains(lower(text), 'propietario') OR contains(lower(text), 'particular') OR contains(lower(text), 'dueño') OR contains(lower(text), 'owner') OR contains(lower(text), 'directo') AS owner FROM ad)""",
    "ad",
)
def _(c: Context) -> DataFrame:
    return jobs.enrich_listings(c.ad).select("listing_id", "bedrooms", F.col("is_owner").alias("owner"))
