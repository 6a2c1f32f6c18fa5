"""Search, counting and scalar-function queries over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.operators import search as s
from quernlog.operators import stats
from quernlog.plans.adapters import WEB, WEB_RAW, WINDOWS, duck_cte, source_table, web_events, windows_events
from quernlog.plans.registry import query

EV = f"WITH {duck_cte(WEB)}, w AS (SELECT *, {WEB_RAW} AS raw FROM ev)"
OUT = "source_id, line_no, epoch_us(ts) AS ts, kind, raw"


def _shape(df: DataFrame) -> DataFrame:
    return df.select("source_id", "line_no", F.unix_micros("ts").alias("ts"), "kind", "raw")


def _eq(field: str, *values: str) -> s.FieldCondition:
    return s.FieldCondition(field, "eq", values)


def _has(field: str, *values: str) -> s.FieldCondition:
    return s.FieldCondition(field, "contains", values)


def _search(name: str, where: str, **params: object) -> None:
    @query(name, f"{EV} SELECT {OUT} FROM w WHERE {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _shape(s.matching(web_events(spark, sf, promoted=False), s.SearchParams("c1", **params)))  # type: ignore[arg-type]


_search("search_text", "contains(lower(raw), 'shell.php')", text="SHELL.php")
_search("search_field_equals", "f_status = '401'", conditions=(_eq("status", "401"),))
_search("search_field_in", "f_status IN ('401', '200')", conditions=(_eq("status", "401", "200"),))
_search(
    "search_field_contains", "contains(lower(f_ua), 'sqlmap') OR contains(lower(f_ua), 'tool1')",
    conditions=(_has("ua", "SQLMAP", "tool1"),),
)
@query("search_raw_equals", f"{EV}, k AS (SELECT min(raw) AS a, max(raw) AS b FROM w) SELECT {OUT} FROM w WHERE raw IN (SELECT a FROM k UNION SELECT b FROM k)")
def raw_equals(spark: SparkSession, sf: str) -> DataFrame:
    """Lines equal to the first or the last line of the table in code point order."""
    events = web_events(spark, sf, promoted=False)
    first, last = events.agg(F.min("raw"), F.max("raw")).first()
    return _shape(s.matching(events, s.SearchParams("c1", conditions=(_eq("raw", first, last),))))
_search("search_raw_contains", "contains(lower(raw), 'curl/') OR contains(lower(raw), 'union')", conditions=(_has("raw", "curl/", "UNION"),))
_search(
    "search_conditions_and", "f_method = 'POST' AND contains(f_path, 'git') AND contains(lower(raw), 'sqlmap')",
    text="sqlmap", conditions=(_eq("method", "POST"), _has("path", ".git")),
)
_search(
    "search_time_window", "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 00:00:00'",
    ts_from="2024-01-05 00:00:00", ts_to="2024-01-06 00:00:00",
)
_search("search_source_set", "source_id IN ('s1', 's4')", source_ids=("s1", "s4"))


@query("search_host_scope", f"{EV}, h AS (SELECT DISTINCT source_id FROM ev WHERE host = 'h1') SELECT {OUT} FROM w WHERE source_id IN (SELECT source_id FROM h)")
def host_scope(spark: SparkSession, sf: str) -> DataFrame:
    events = web_events(spark, sf)
    sources = source_table(events)
    return _shape(s.matching(events.drop("host"), s.SearchParams("c1", host="h1"), sources))


@query(
    "search_page",
    f"{EV} SELECT {OUT} FROM w WHERE f_status = '200' ORDER BY source_id, line_no LIMIT 50 OFFSET 100",
)
def page(spark: SparkSession, sf: str) -> DataFrame:
    params = s.SearchParams("c1", conditions=(_eq("status", "200"),), limit=50, offset=100)
    return _shape(s.search(web_events(spark, sf), params))


@query(
    "search_page_after",
    f"{EV} SELECT {OUT} FROM w WHERE f_status = '200' AND (source_id > 's3' OR source_id = 's3' AND line_no > 100) ORDER BY source_id, line_no LIMIT 50",
)
def page_after(spark: SparkSession, sf: str) -> DataFrame:
    params = s.SearchParams("c1", conditions=(_eq("status", "200"),), limit=50, after=("s3", 100))
    return _shape(s.search(web_events(spark, sf), params))


def _counts(name: str, group: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return stats.event_counts(web_events(spark, sf), "c1", group)


_counts("stats_by_status", "status", f"{EV} SELECT f_status AS key, count(*) AS events FROM w GROUP BY 1")
_counts("stats_by_day", "day", f"{EV} SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS events FROM w WHERE ts IS NOT NULL GROUP BY 1")
_counts("stats_by_source", "source", f"{EV} SELECT source_id AS key, count(*) AS events FROM w GROUP BY 1")


@query("timeline_hours", f"{EV} SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS bucket_start, count(*) AS events FROM w WHERE ts IS NOT NULL GROUP BY 1")
def hours(spark: SparkSession, sf: str) -> DataFrame:
    return stats.timeline(web_events(spark, sf), "c1")


@query("timeline_untimed_sources", f"{EV} SELECT source_id, count(*) AS events FROM w WHERE ts IS NULL GROUP BY 1")
def untimed(spark: SparkSession, sf: str) -> DataFrame:
    return stats.untimed_sources(web_events(spark, sf), "c1")


@query("heavy_hitters_src_ip", f"{EV} SELECT f_src_ip AS value, count(*) AS events FROM w WHERE kind = 'event' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hitters(spark: SparkSession, sf: str) -> DataFrame:
    return stats.heavy_hitters(web_events(spark, sf), "src_ip")


@query(
    "ingest_source_accounts",
    f"""{EV} SELECT source_id, count(*) AS rows_total, count(CASE WHEN kind = 'event' THEN 1 END) AS rows_event,
  count(CASE WHEN kind = 'bad' THEN 1 END) AS rows_bad, count(CASE WHEN kind = 'skip' THEN 1 END) AS rows_skip,
  CASE WHEN count(CASE WHEN kind = 'bad' THEN 1 END) > 0.05 * count(CASE WHEN kind IN ('bad', 'event') THEN 1 END)
    THEN 'suspect' ELSE 'ok' END AS detect_status FROM w GROUP BY source_id""",
)
def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.source_accounts(web_events(spark, sf)).drop("case_id")


@query(
    "event_scan_one_source",
    f"{EV} SELECT {OUT} FROM w WHERE kind = 'event' AND source_id = 's3'",
)
def scan(spark: SparkSession, sf: str) -> DataFrame:
    params = s.SearchParams("c1", source_ids=("s3",), kind="event")
    return _shape(s.matching(web_events(spark, sf), params))


@query(
    "field_with_data_fallback",
    f"WITH {duck_cte(WINDOWS)} SELECT source_id, line_no, CAST(f_event_id AS BIGINT) AS event_id, d_TargetUserName AS target_user FROM ev",
)
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    from quernlog.functions.fields import event_id, promote

    rows = promote(windows_events(spark, sf, promoted=False), ["event_id"], ["TargetUserName"])
    return rows.select("source_id", "line_no", event_id().alias("event_id"), F.col("d_TargetUserName").alias("target_user"))


@query("distinct_hosts", f"{EV} SELECT DISTINCT host FROM w WHERE host <> ''")
def hosts(spark: SparkSession, sf: str) -> DataFrame:
    return web_events(spark, sf).filter("host <> ''").select("host").distinct()


@query(
    "events_with_source",
    f"{EV}, d AS (SELECT source_id, max(log_type) AS lt FROM ev GROUP BY 1) SELECT d.lt AS log_type, count(*) AS events FROM w JOIN d USING (source_id) GROUP BY 1",
)
def joined(spark: SparkSession, sf: str) -> DataFrame:
    from quernlog.functions.fields import with_source

    events = web_events(spark, sf)
    sources = source_table(events)
    return with_source(events.drop("log_type", "host"), sources, ["log_type", "host"]).groupBy("log_type").agg(
        F.count(F.lit(1)).alias("events")
    )
