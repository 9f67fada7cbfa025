"""Named queries: a function of (spark, folder) and, where SQL can say it, the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import derived, diary, feeds, ingest, listings, mailbox, merges, recaps, rollups, searches, sightings, syncs, teams  # noqa: F401

    return QUERIES, ORACLES
