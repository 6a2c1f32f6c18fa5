"""Entities that come back in several sources or on several hosts of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import column_name, promote, route, with_source
from quernlog.functions.net import public_ip
from quernlog.operators.findings import finding

# Value fields per log type.  Fixed values.
IP_FIELDS = {"web_access": ["src_ip"], "windows_event_log": ["IpAddress", "SourceNetworkAddress"]}
ENTITY_FIELDS = {
    "account_sid": ["SubjectUserSid", "TargetUserSid", "MemberSid", "user_sid", "sid"],
    "file_sha256": ["sha256", "file_sha256", "SHA256", "hash_sha256"],
}


def normalize_entity(entity_type: str, raw: Column) -> Column:
    """Comparable form of a value, NULL when it is not of that kind."""
    if entity_type == "ip":
        return public_ip(raw)
    if entity_type == "account_sid":
        value = F.upper(F.trim(raw))
        return F.when(value.rlike(r"^S-\d+(-\d+)+$"), value)
    if entity_type == "file_sha256":
        value = F.lower(F.trim(raw))
        return F.when(value.rlike("^[0-9a-f]{64}$"), value)
    raise ValueError("entity_type must be ip, account_sid or file_sha256")


def _first_usable(entity_type: str, fields: list[str]) -> Column:
    """First field of the list that holds a valid value: one entity per event."""
    def valid(text: Column) -> Column:
        return F.when(~text.isin("", "-", "::1"), normalize_entity(entity_type, text))

    tests = [valid(F.col(column_name("d", f))) for f in fields]
    return F.coalesce(*tests) if len(tests) > 1 else tests[0]


def _per_source(
    events: DataFrame,
    sources: DataFrame | None,
    entity_type: str,
    fields_by_log_type: dict[str, list[str]] | None,
    default_fields: list[str],
    with_host: bool,
    log_types: tuple[str, ...],
) -> DataFrame:
    attributes = ["log_type"] if (fields_by_log_type is not None or log_types) else []
    rows = with_source(events, sources, attributes + (["host"] if with_host else []))
    rows = route(rows, sources, log_types)
    if with_host:
        rows = rows.filter(F.coalesce("host", F.lit("")) != "")
    if fields_by_log_type is None:
        rows = promote(rows, data_keys=default_fields)
        entity = _first_usable(entity_type, default_fields)
    else:
        rows = rows.filter(F.col("log_type").isin(list(fields_by_log_type)))
        rows = promote(rows, data_keys=[f for fs in fields_by_log_type.values() for f in fs])
        entity = F.lit(None).cast("string")
        for log_type, fields in fields_by_log_type.items():
            entity = F.when(F.col("log_type") == log_type, _first_usable(entity_type, fields)).otherwise(entity)
    host = ["host"] if with_host else []
    return (
        rows.select("case_id", *host, "source_id", "line_no", "ts", entity.alias("entity"))
        .filter(F.col("entity").isNotNull())
        .groupBy("case_id", "entity", *host, "source_id")
        .agg(F.count(F.lit(1)).alias("events"), F.min(F.struct("line_no", "ts")).alias("_first"))
    )


def _order() -> Column:
    """Earliest first: by time where known, then line, then source."""
    ts = F.col("_first.ts")
    return F.struct(
        ts.isNull().alias("a"), ts.alias("b"), F.col("_first.line_no").alias("c"), F.col("source_id").alias("d")
    )


def entity_sources(
    events: DataFrame, sources: DataFrame | None = None, *, ip_fields: dict[str, list[str]] | None = None,
    log_types: tuple[str, ...] = ("web_access", "windows_event_log"),
) -> DataFrame:
    """Long form: one row per public address and source with its event count and first line."""
    rows = _per_source(events, sources, "ip", ip_fields or IP_FIELDS, [], False, log_types)
    return rows.select("case_id", "entity", "source_id", "events", F.col("_first.line_no").alias("first_line"))


def cross_entity_multi_source(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    min_sources: int = 2,
    ip_fields: dict[str, list[str]] | None = None,
    log_types: tuple[str, ...] = ("web_access", "windows_event_log"),
) -> DataFrame:
    """Public addresses found in several sources."""
    per_source = _per_source(events, sources, "ip", ip_fields or IP_FIELDS, [], False, log_types)
    hits = (
        per_source.groupBy("case_id", "entity")
        .agg(
            F.count(F.lit(1)).alias("source_count"),
            F.sum("events").alias("total_events"),
            F.min_by(F.struct("source_id", "_first"), _order()).alias("_anchor"),
        )
        .filter(F.col("source_count") >= max(2, min_sources))
        .select("*", "_anchor.source_id", F.col("_anchor._first.line_no").alias("line_no"), F.col("_anchor._first.ts").alias("_ts"))
    )
    return finding(
        hits, "cross-entity-multi-source", "entity", F.col("entity"),
        {"source_count": F.col("source_count"), "total_events": F.col("total_events")},
        points=F.col("source_count"), linked=True, ts=F.col("_ts"),
    )


def cross_host_entity(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    min_hosts: int = 2,
    entity_type: str = "ip",
    ip_fields: dict[str, list[str]] | None = None,
    entity_fields: dict[str, list[str]] | None = None,
    log_types: tuple[str, ...] = ("web_access", "windows_event_log"),
) -> DataFrame:
    """The same address, account SID or file hash on several hosts; sources without a host are left out."""
    by_type = (ip_fields or IP_FIELDS) if entity_type == "ip" else entity_fields
    per_source = _per_source(
        events, sources, entity_type, by_type, ENTITY_FIELDS.get(entity_type, []), True, log_types
    )
    per_host = per_source.groupBy("case_id", "entity", "host").agg(
        F.sum("events").alias("events"),
        F.count(F.lit(1)).alias("sources"),
        F.min_by(F.struct("source_id", "_first"), _order()).alias("_a"),
    ).select("*", "_a.source_id", "_a._first")
    hits = (
        per_host.groupBy("case_id", "entity")
        .agg(
            F.count(F.lit(1)).alias("host_count"),
            F.sum("sources").alias("source_count"),
            F.sum("events").alias("total_events"),
            F.min_by(F.struct("source_id", "_first"), _order()).alias("_anchor"),
        )
        .filter(F.col("host_count") >= max(2, min_hosts))
        .select("*", "_anchor.source_id", F.col("_anchor._first.line_no").alias("line_no"), F.col("_anchor._first.ts").alias("_ts"))
    )
    return finding(
        hits, "cross-host-entity", "entity", F.col("entity"),
        {
            "entity_type": F.lit(entity_type),
            **{c: F.col(c) for c in ("host_count", "source_count", "total_events")},
        },
        points=F.col("host_count"), linked=True, ts=F.col("_ts"),
    )


def unmodeled_sources(sources: DataFrame) -> DataFrame:
    """How many sources per case take no part in host correlation because their host is unknown."""
    return sources.groupBy("case_id").agg(
        F.count_if(F.coalesce("host", F.lit("")) == "").alias("unmodeled_sources_skipped")
    )
