"""Catalogue of runnable queries, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from quernlog.plans import (  # noqa: F401
        q_candidates,
        q_catalogue,
        q_detect,
        q_host_texts,
        q_review,
        q_rules,
        q_search,
        q_sources,
        q_streaming,
    )
