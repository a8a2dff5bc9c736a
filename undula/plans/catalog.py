"""The registered queries of the signal operators and their SQL."""

from __future__ import annotations

from undula.plans import chunk_queries, device_queries, edit_queries, file_queries, measure_queries, mix_queries  # noqa: F401
from undula.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
