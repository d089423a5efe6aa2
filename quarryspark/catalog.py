"""All queries of the engine's own operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregate, analysis, cases, dedupe, extract, pipelines, resolve, scalars, search  # noqa: F401  importing registers the operators
from .plans.register import QUERIES, SQL
from .sources import files, listing  # noqa: F401
from .streaming import jobs  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One callable for each operator."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express."""
    return dict(SQL)
