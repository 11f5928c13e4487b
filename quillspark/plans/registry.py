"""Every registered query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import core_queries, reference_queries, stored_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reference_queries.QUERIES, **stored_queries.QUERIES, **core_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reference_queries.SQL, **stored_queries.SQL, **core_queries.SQL}
