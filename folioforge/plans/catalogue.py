"""The catalogue of registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import enrichment, graphs, retrieval, splits, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (retrieval, graphs, splits, enrichment, stored):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
