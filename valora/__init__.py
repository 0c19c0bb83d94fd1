"""Valora: property-listing analytics expressed as Spark DataFrame operations."""
