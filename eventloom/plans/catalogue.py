"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from eventloom.plans import io_queries, mining_queries, object_queries, table_queries  # noqa: F401  (each registers its queries)
from eventloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
