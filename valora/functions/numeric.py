"""Numeric column expressions: transforms, hashing, distance, rounding."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora.functions.fixed import EARTH_RADIUS_KM


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: str | Column, digits: int = 4) -> Column:
    """Round half up in plain binary arithmetic, the same on every engine.

    A value within 1e-5 of the half step counts as the half, so that the last bits of a sum, which
    depend on the order of the rows, do not decide.
    """
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.50001)) / F.lit(scale)


def no_nan(c: str | Column) -> Column:
    """NaN to NULL, so that averages and medians skip it."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def to_num(c: str | Column) -> Column:
    return col(c).try_cast("double")


def null_if(c: str | Column, bad: Column) -> Column:
    return F.when(~F.coalesce(bad, F.lit(False)), col(c))


def price_per_m2(price: str | Column, m2: str | Column, min_m2: float = 0.0, digits: int | None = None) -> Column:
    ratio = col(price) / col(m2)
    if digits is not None:
        ratio = half_up(ratio, digits)
    return F.when(col(m2) > F.lit(min_m2), ratio)


def log_t(c: str | Column) -> Column:
    return F.log1p(col(c))


def log_inv(c: str | Column) -> Column:
    return F.expm1(col(c))


def boxcox(c: str | Column, lam: float) -> Column:
    return F.log(col(c)) if lam == 0 else (F.pow(col(c), F.lit(lam)) - 1) / F.lit(lam)


def inv_boxcox(c: str | Column, lam: float) -> Column:
    return F.exp(col(c)) if lam == 0 else F.pow(col(c) * F.lit(lam) + 1, F.lit(1 / lam))


def target_transform(name: str, lam: float = 0.0) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """A pluggable (forward, inverse) pair of column functions."""
    if name == "log1p":
        return log_t, log_inv
    if name == "boxcox":
        return (lambda c: boxcox(c, lam)), (lambda c: inv_boxcox(c, lam))
    return (lambda c: c), (lambda c: c)


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; values outside all bins give NULL."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        upper = F.lit(True) if math.isinf(high) else col(c) <= high
        out = F.when((col(c) > low) & upper, F.lit(label)).otherwise(out)
    return out


def price_range(p: str | Column, pct: float = 0.15) -> tuple[Column, Column]:
    return col(p) * F.lit(1 - pct), col(p) * F.lit(1 + pct)


def age_days(date: str | Column, as_of: str, default: int) -> Column:
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), col(date).cast("date")), F.lit(default))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit_hash(key: str | Column, salt: object) -> Column:
    """Deterministic uniform number in [0, 1) from a key and a salt, portable across engines."""
    salt_col = salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.substring(F.md5(F.concat(col(key).cast("string"), F.lit("|"), salt_col)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)
