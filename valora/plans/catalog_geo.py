"""Queries for the radius joins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from valora.operators import geo
from valora.plans.catalog_columns import _CATS, hav_sql
from valora.plans.registry import Context, query, sql_has_any

_HAV = hav_sql("l.lat", "l.lon", "p.lat", "p.lon")
_HAVB = hav_sql("a.lat", "a.lon", "b.lat", "b.lon")


@query(
    "e6_poi_radius_counts",
    f""", s AS (SELECT DISTINCT lat, lon FROM listing), d AS (SELECT l.lat AS la, l.lon AS lo, p.activity AS act, {_HAV} AS km FROM s l JOIN poi p
          ON abs(l.lat - p.lat) < 0.02 AND abs(l.lon - p.lon) < 0.02),
        g AS (SELECT la, lo, {', '.join(f"count(*) FILTER (WHERE km <= {r} AND {sql_has_any('lower(act)', [w.lower() for w in ws])}) AS {c}_{int(r * 1000)}m" for r in (0.5, 1.0) for c, ws in _CATS.items())}
          FROM d GROUP BY la, lo)
        SELECT listing_id, {', '.join(f"coalesce({c}_{int(r * 1000)}m, 0) AS {c}_{int(r * 1000)}m" for r in (0.5, 1.0) for c in _CATS)} FROM listing LEFT JOIN g ON la = lat AND lo = lon""",
    "listing poi",
)
def _(c: Context) -> DataFrame:
    return geo.poi_counts(c.listing, c.poi, "listing_id", "activity", [0.5, 1.0], _CATS)


@query(
    "e7_supply_density",
    f""", s AS (SELECT lat, lon, count(*) AS n FROM listing GROUP BY lat, lon),
        g AS (SELECT a.lat AS la, a.lon AS lo, CAST(sum(b.n) AS BIGINT) AS n FROM s a JOIN s b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.02 WHERE {_HAVB} <= 0.5 GROUP BY ALL)
        SELECT listing_id, n - 1 AS density FROM listing JOIN g ON la = lat AND lo = lon""",
    "listing",
)
def _(c: Context) -> DataFrame:
    return geo.supply_density(c.listing, "listing_id", 0.5)
