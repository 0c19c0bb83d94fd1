"""Loads every query module into the registry."""

from valora.plans import (  # noqa: F401
    catalog_aggregates, catalog_columns, catalog_evaluation, catalog_geo, catalog_models, catalog_relational,
    catalog_retrieval, catalog_sources, catalog_streams,
)
from valora.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
