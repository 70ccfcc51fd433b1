"""The registered queries and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "q_exact_dedup"


def register(name: str, sql: str | None = None):
    """Registers a query under ``name`` with the SQL that DuckDB runs for it."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Imports the modules that register queries."""
    from millrace.plans import audits, calls, events, importing, metrics, prepare, records, sampling, streams, tokens  # noqa: F401


load()
