"""All queries of the package by name, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_queries, function_queries, record_queries, score_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(sorted({**data_queries.QUERIES, **function_queries.QUERIES, **record_queries.QUERIES, **score_queries.QUERIES}.items()))
ORACLE_SQL: dict[str, str] = {**data_queries.SQL, **function_queries.SQL, **record_queries.SQL, **score_queries.SQL}
