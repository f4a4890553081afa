"""Queries by name, and DuckDB SQL for each one that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaarlake.plans import analytics, changes, market, pages, texts

PARTS = (market, analytics, texts, changes, pages)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
