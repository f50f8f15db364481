"""All queries of the engine's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from quillmark.plans import graph_queries, search_queries, tool_queries  # noqa: F401  they register themselves
from quillmark.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
