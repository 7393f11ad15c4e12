"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Enters a query, a function of (spark, sf_dir), and its SQL."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load():
    from . import chunk_queries, code_queries, dedup_queries, diff_queries, format_queries, placement_queries, planner_queries, recovery_queries, store_queries, validation_queries, version_queries  # noqa: F401


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)
