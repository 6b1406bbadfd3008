"""Every operator on the driver's tables, with the SQL that must give the same rows."""

from queries.registry import ORACLES, QUERIES

from queries import (  # noqa: F401
    aggregates, configuration, decisions, events, history, jobs, lookups, providers, streams,
)

__all__ = ["ORACLES", "QUERIES"]
