"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query; without ``oracle`` only its rows are checked by the driver."""
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn
    return add


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def load() -> None:
    from . import queries_events, queries_graph, queries_ingest, queries_report, queries_vendors  # noqa: F401
