"""Registry of contract queries and their DuckDB oracles."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with its oracle when SQL can express it."""

    def keep(run):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = run
        if sql:
            _ORACLES[name] = sql
        return run

    return keep


def _load() -> None:
    """Import every module of queries once."""
    from pagemill.plans import q_chapters, q_logs, q_merge, q_ordered, q_signatures, q_sources, q_streaming, q_text  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)
