"""Counts over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlog.operators.search import field_value


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def event_counts(
    events: DataFrame, case_id: str, group: str, limit: int | None = None, source_ids: tuple[str, ...] = ()
) -> DataFrame:
    """Buckets by 'status', 'day' or 'source', the largest first: (key, events).  All of them unless a limit is given."""
    rows = events.filter(F.col("case_id") == case_id)
    if source_ids:
        rows = rows.filter(F.col("source_id").isin(*source_ids))
    if group == "status":
        key = F.coalesce(F.nullif(field_value(events, "status"), F.lit("")), F.lit("(none)"))
    elif group == "day":
        rows = rows.filter(F.col("ts").isNotNull())
        key = F.date_format("ts", "yyyy-MM-dd")
    elif group == "source":
        key = F.col("source_id")
    else:
        raise ValueError("group must be status, day or source")
    counted = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("events"))
    return _first(counted.orderBy(F.col("events").desc(), "key"), limit)


def timeline(events: DataFrame, case_id: str) -> DataFrame:
    """Events per hour: (bucket_start in epoch seconds, events), earliest first."""
    return (
        events.filter((F.col("case_id") == case_id) & F.col("ts").isNotNull())
        .groupBy(F.unix_seconds(F.date_trunc("hour", "ts")).alias("bucket_start"))
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy("bucket_start")
    )


def untimed_sources(events: DataFrame, case_id: str, limit: int | None = None) -> DataFrame:
    """Sources with events whose time is unknown, the largest first."""
    counted = (
        events.filter((F.col("case_id") == case_id) & F.col("ts").isNull())
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("events").desc(), "source_id")
    )
    return _first(counted, limit)


def heavy_hitters(events: DataFrame, field: str, top: int = 20) -> DataFrame:
    """Most frequent values of one field among events."""
    return (
        events.filter(F.col("kind") == "event")
        .groupBy(field_value(events, field).alias("value"))
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("events").desc(), "value")
        .limit(top)
    )


def source_accounts(events: DataFrame) -> DataFrame:
    """Lines per source by kind, and the share of bad ones that makes a source suspect."""
    counted = events.groupBy("case_id", "source_id").agg(
        F.count(F.lit(1)).alias("rows_total"),
        *[F.count_if(F.col("kind") == k).alias(f"rows_{k}") for k in ("event", "bad", "skip")],
    )
    parsed = F.col("rows_event") + F.col("rows_bad")
    return counted.withColumn(
        "detect_status", F.when(F.col("rows_bad") > 0.05 * parsed, "suspect").otherwise("ok")
    )
