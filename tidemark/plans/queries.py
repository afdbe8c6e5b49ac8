"""The engine's operators applied to the given tables, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import accounts, books, live, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**series.QUERIES, **books.QUERIES, **accounts.QUERIES, **live.QUERIES}
