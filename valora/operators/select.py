"""Row filters whose bounds come from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.operators.quantile import scalar_quantile


def price_window(df: DataFrame, lo: float = fixed.PRICE_FLOOR, q: float = 0.99, price: str = "price") -> DataFrame:
    """Prices between a floor and an exact quantile of the raw column, both inclusive."""
    return df.filter(F.col(price).between(F.lit(lo), scalar_quantile(df, price, q)))


def trim_q(df: DataFrame, value: str, q: float, strict: bool = True) -> DataFrame:
    """Drop rows above the quantile (not a cap: see ``winsorize_by``)."""
    cut = scalar_quantile(df, value, q)
    return df.filter(F.col(value) < cut if strict else F.col(value) <= cut)


def valid_price(df: DataFrame, price: str = "price") -> DataFrame:
    return df.filter(F.col(price) > 0)


def price_cap(df: DataFrame, cap: float = fixed.PRICE_CAP, price: str = "price") -> DataFrame:
    return df.filter(F.col(price) <= cap)


def in_category(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(column))).isin(list(values)), F.lit(False))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def rooms_in(column: str, values: Sequence[int]) -> Column:
    """Membership with an unknown number of rooms counted as 0."""
    return F.coalesce(F.col(column), F.lit(0)).isin(list(values))


def search_leads(df: DataFrame, score: str, fields: Sequence[str], q: str) -> DataFrame:
    hay = F.lower(F.concat_ws("", *fields))
    return df.filter((F.col(score) > 0) & hay.contains(q.lower().strip()))


def long_enough(df: DataFrame, messages: str, size: int = 200) -> DataFrame:
    """Drop examples whose serialised form is tiny."""
    return df.filter(F.length(F.to_json(F.struct(messages))) > size)
