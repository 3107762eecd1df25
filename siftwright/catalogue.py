"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_content, queries_fixtures, queries_notices, queries_pages, queries_store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = queries_pages.QUERIES | queries_store.QUERIES | queries_fixtures.QUERIES | queries_notices.QUERIES | queries_content.QUERIES
SQL: dict[str, str] = queries_pages.SQL | queries_store.SQL | queries_fixtures.SQL | queries_notices.SQL | queries_content.SQL
