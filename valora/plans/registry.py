"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from valora.session import materialize, tune
from valora.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Context:
    """What a query gets: the session and the tables and views of one data folder."""

    spark: SparkSession
    sf_dir: str

    def stored(self, name: str, *cols: str) -> DataFrame:
        """The wanted columns of a view as a stored table: for jobs that read a joined view often."""
        return materialize(view(self.spark, self.sf_dir, name).select(*cols), name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the listing-domain views the SQL uses."""

    def register(fn: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Context(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = f"{with_views(*views.split())} {sql}" if views else sql
        return fn

    return register


def rnd(expr: str, digits: int = 4) -> str:
    """SQL twin of :func:`valora.functions.numeric.half_up`."""
    scale = f"{10**digits}.0"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.50001) / {scale})"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_has_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_unit(key: str, salt: str) -> str:
    """SQL twin of :func:`valora.functions.numeric.unit_hash`."""
    return f"(CAST(('0x' || substr(md5(concat({key}, '|', {salt})), 1, 8)) AS BIGINT) / 4294967296.0)"
