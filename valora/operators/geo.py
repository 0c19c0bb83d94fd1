"""Radius counts between two sets of points, without comparing every pair.

Equal coordinates are merged first, so a place that holds a large share of all rows is one point
with a weight. The rest goes through two grid levels, in plain coordinates up to 80 degrees of
latitude and in turned ones, whose equator runs through the poles, beyond. Whole cells that lie inside the circle of a
point are added as a single count; cells outside are never looked at; cells the circle cuts are split
into quarters where they are dense, and only the points of small cut cells are compared, with the exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.numeric import haversine
from valora.operators.quantile import attach
from valora.session import materialize

KM_PER_DEGREE_LAT = 6371.0 * math.pi / 180
FINE = 4  # fine cells per largest radius
POLAR = 80.0  # points beyond this latitude are counted in turned coordinates
LEAF = 512  # distinct places in a cell that is not split
MAX_LEVEL = 16  # halvings of the cells
MAX_RADIUS_KM = 500.0  # squares of cells stay far below a full turn


def _grid(max_lat: float, radius_km: float) -> tuple[float, float]:
    """Cell height and width in degrees: a quarter of the radius, at the latitude where degrees of
    longitude are shortest."""
    height = radius_km / KM_PER_DEGREE_LAT / FINE
    return height, height / math.cos(math.radians(max_lat))


def _plain(lon: Column | None = None) -> Column:
    lon = F.col("lon") if lon is None else lon
    return F.struct(F.lit(False).alias("polar"), F.col("lat").alias("gy"), lon.alias("gx"))


def _turned() -> Column:
    """The same sphere, turned so that the poles lie on the equator; distances stay."""
    y, x = F.radians("lat"), F.radians("lon")
    up, east = F.degrees(F.asin(F.cos(y) * F.cos(x))), F.degrees(F.atan2(F.sin(y), F.cos(y) * F.sin(x)))
    return F.struct(F.lit(True).alias("polar"), up.alias("gy"), east.alias("gx"))


def _frames(margin: float, span: float) -> Column:
    """Every grid position at which a target can be met: in both coordinate systems near their border, and
    a turn further where it is within ``span`` degrees of the date line."""
    lon = _within_turn()
    low, high = F.abs("lat") <= POLAR + margin, F.abs("lat") >= POLAR - margin
    return F.array_compact(F.array(
        F.when(low, _plain(lon)), F.when(low & (lon >= 180 - span), _plain(lon - 360)), F.when(low & (lon <= span - 180), _plain(lon + 360)),
        F.when(high, _turned())))


def _within_turn() -> Column:
    return F.when(F.abs("lon") > 180, F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).otherwise(F.col("lon"))


def _cell(lat: str, lon: str, height: float, width: float) -> tuple[Column, Column]:
    return F.floor(F.col(lat) / height), F.floor(F.col(lon) / width)


def _walk(
    places: DataFrame, targets: DataFrame, radii: Sequence[float], cats: Sequence[str], cat_array: str, leaf: int,
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Counts of whole cells, and the (place, target) pairs left to compare, one table of each per grid level.

    Cells with more than ``leaf`` distinct target places are split into four, again and again, so that a cell
    that is cut by a circle and compared point by point never holds many; splitting stops at ``MAX_LEVEL``.
    """
    spots = materialize(places.select("lat", "lon").distinct(), "spots")
    counts = [f"n_{i}" for i in range(len(cats))]
    found = materialize(
        targets.filter("lat IS NOT NULL AND lon IS NOT NULL")
        .groupBy("lat", "lon")
        .agg(*[F.count_if(F.array_contains(cat_array, c)).alias(n) for n, c in zip(counts, cats)]),
        "targets",
    )
    limit = spots.agg(F.max(F.abs("lat")).alias("m")).unionByName(found.agg(F.max(F.abs("lat")).alias("m")))
    # The widest latitude fixes the cell width; a degree and the radius cover circles reaching beyond it.
    margin = radii[-1] / KM_PER_DEGREE_LAT * 1.01
    max_lat = min(limit.agg(F.max("m")).first()[0] or 0.0, POLAR) + 1.0 + margin
    height, width = _grid(max_lat, radii[-1])
    dots = found.select("*", F.inline(_frames(margin, (FINE + 2) * width)))

    # The cells a circle can touch form a fixed square around the point's own cell. Longitude cells
    # were sized at the widest latitude, where they are shortest in km, so FINE + 1 steps suffice.
    placed = spots.select("lat", "lon", F.inline(F.array(F.when(F.abs("lat") > POLAR, _turned()).otherwise(_plain(_within_turn())))))
    px, py = _cell("gy", "gx", height, width)
    steps = F.sequence(F.lit(-FINE - 1), F.lit(FINE + 1))
    front = (
        placed.withColumn("dx", F.explode(steps)).withColumn("tx", px + F.col("dx"))
        .withColumn("dy", F.explode(steps)).withColumn("ty", py + F.col("dy")).drop("dx", "dy").withColumn("done", F.lit(0))
    )
    key, sums, pairs = ["polar", "tx", "ty"], [], []
    for level in range(MAX_LEVEL + 1):
        tx, ty = _cell("gy", "gx", height, width)
        dots = materialize(dots.withColumn("tx", tx).withColumn("ty", ty), "targets")
        cells = materialize(dots.groupBy(*key).agg(F.count("*").alias("m"), *[F.sum(n).alias(n) for n in counts]), "cells")
        splits = (F.col("m") > leaf) & F.lit(level < MAX_LEVEL)
        # Bounds of the distance to any point of the cell from the distance to its centre.
        center = haversine("gy", "gx", (F.col("tx") + 0.5) * height, (F.col("ty") + 0.5) * width)
        # Half the diagonal, at the latitude inside the cell where it is longest.
        near_equator = F.least(F.abs(F.col("tx") * height), F.abs((F.col("tx") + 1) * height))
        half_w = F.lit(width / 2 * KM_PER_DEGREE_LAT) * F.cos(F.radians(near_equator))
        half_d = F.sqrt(half_w * half_w + F.lit((height / 2 * KM_PER_DEGREE_LAT) ** 2)) * 1.001
        met = front.withColumn("c", center).withColumn("h", half_d).filter(F.col("c") - F.col("h") <= radii[-1]).join(cells, key)
        # Radii that hold the whole cell, and did not hold one around it; those that cut it.
        fresh = [F.col("done").bitwiseAND(1 << j) == 0 for j in range(len(radii))]
        whole = [f & (F.col("c") + F.col("h") <= r) for f, r in zip(fresh, radii)]
        cut = reduce(or_, [f & ~w & (F.col("c") - F.col("h") <= r) for f, w, r in zip(fresh, whole, radii)])
        now = reduce(add, [F.when(w, 1 << j).otherwise(0) for j, w in enumerate(whole)])
        met = met.withColumn("now", now).withColumn("cut", cut).withColumn("done", F.col("done") + F.col("now"))
        met = materialize(met.filter("now > 0 OR cut"), "met")
        sums.append(met.filter("now > 0").groupBy("lat", "lon").agg(*_columns([F.col("now").bitwiseAND(1 << j) > 0 for j in range(len(radii))], counts)))
        edge = met.filter(F.col("cut") & ~splits).select("lat", "lon", *key, "done")
        pairs.append(edge.join(dots.select(*key, F.col("lat").alias("la"), F.col("lon").alias("lo"), *counts), key))
        dense = cells.filter(splits).select(*key)
        if dense.isEmpty():
            break
        # The four quarters of the cells that are cut and dense, and the targets in dense cells.
        quarter = F.explode(F.array(*[F.struct((F.col("tx") * 2 + i).alias("x"), (F.col("ty") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)]))
        front = met.filter(F.col("cut") & splits).select("lat", "lon", "polar", "gy", "gx", "done", quarter.alias("q"))
        front = front.select("lat", "lon", "polar", "gy", "gx", F.col("q.x").alias("tx"), F.col("q.y").alias("ty"), "done")
        dots = dots.join(dense, key, "left_semi").drop("tx", "ty")
        # Halves are exact, so a quarter lies in its cell also after rounding.
        height, width = height / 2, width / 2
    return sums, pairs


def _columns(test: Sequence[Column], counts: Sequence[str]) -> list[Column]:
    return [F.sum(F.when(t, F.col(n)).otherwise(0)).alias(f"s_{j}_{i}") for j, t in enumerate(test) for i, n in enumerate(counts)]


def _located(points: DataFrame, *cols: str) -> DataFrame:
    return points.select(*cols, "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL")


def radius_counts(
    points: DataFrame,
    targets: DataFrame,
    key: str,
    radii_km: Sequence[float],
    cats: Sequence[str],
    cat_array: str = "cats",
    leaf: int = LEAF,
) -> DataFrame:
    """Number of targets of each category within each radius of each point.

    ``targets`` has ``lat``, ``lon`` and an array of categories. The result has one row per point
    and one column ``<cat>_<metres>m`` per category and radius. Circles may hold a pole or cross the date
    line; radii go up to 500 km. ``leaf`` is the number of target places beyond which a cell is split.
    """
    radii = sorted(radii_km)
    if radii[-1] > MAX_RADIUS_KM:
        raise ValueError(f"radius above {MAX_RADIUS_KM} km")
    places = _located(points, key)
    sums, pairs = _walk(places, targets, radii, cats, cat_array, leaf)
    dist = haversine("lat", "lon", "la", "lo")
    for table in pairs:
        close = table.withColumn("d", dist).filter(F.col("d") <= radii[-1])
        exact = [(F.col("done").bitwiseAND(1 << j) == 0) & (F.col("d") <= r) for j, r in enumerate(radii)]
        sums.append(close.groupBy("lat", "lon").agg(*_columns(exact, [f"n_{i}" for i in range(len(cats))])))
    names = {f"s_{j}_{i}": f"{c}_{round(r * 1000)}m" for j, r in enumerate(radii) for i, c in enumerate(cats)}
    total = reduce(DataFrame.unionByName, sums).groupBy("lat", "lon").agg(*[F.sum(s).alias(n) for s, n in names.items()])
    got = attach(places, total, ["lat", "lon"])
    return got.select(key, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names.values()])


def pairs_compared(points: DataFrame, targets: DataFrame, radii_km: Sequence[float], cats: Sequence[str], cat_array: str = "cats", leaf: int = LEAF) -> int:
    """How many distances :func:`radius_counts` takes between single places."""
    return sum(p.count() for p in _walk(_located(points), targets, sorted(radii_km), cats, cat_array, leaf)[1])


def supply_density(points: DataFrame, key: str, radius_km: float = 0.5, out: str = "density") -> DataFrame:
    """Other listings within the radius of each listing."""
    targets = points.select("lat", "lon", F.array(F.lit("all")).alias("cats"))
    got = radius_counts(points, targets, key, [radius_km], ["all"])
    return got.select(key, (F.col(f"all_{round(radius_km * 1000)}m") - 1).alias(out))


def poi_counts(listings: DataFrame, poi: DataFrame, key: str, activity: str, radii_km: Sequence[float], cats: Mapping[str, Sequence[str]]) -> DataFrame:
    from valora.functions.parse import categorise_poi

    tagged = poi.select("lat", "lon", categorise_poi(activity, cats).alias("cats")).filter(F.size("cats") > 0)
    return radius_counts(listings, tagged, key, radii_km, list(cats))
