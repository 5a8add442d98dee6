"""The engine's registered queries."""

from __future__ import annotations

from korrel.queries import documents, explore, facts, functions, guarded, indexes, linking, logs, ranking, relational, rules, streams, syntax, text  # noqa: F401
from korrel.queries.guarded import flagship
from korrel.queries.registry import QUERIES, SQL

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
