"""The star-schema test tables seen as log events.

Every expression is plain SQL that Spark and other engines read alike; ``{k}`` stands for the number in
the JSON text of ``events.props``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.functions.fields import computed_once

# tables whose rows are costly to work on
SPREAD = {"events", "documents", "pages"}
K_SPARK = "CAST(get_json_object(props, '$.k') AS BIGINT)"
K_DUCK = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

_SOURCE = "'s' || CAST((user_id % 3) * 2 + (event_id % 2) AS STRING)"
_HOST = "CASE WHEN user_id % 3 = 2 AND event_id % 2 = 1 THEN '' ELSE 'h' || CAST(event_id % 2 AS STRING) END"
_TS = "CASE WHEN event_id % 97 = 5 THEN NULL ELSE date_trunc('MILLISECOND', CAST(ts AS TIMESTAMP)) END"

WEB = {
    "case_id": "'c1'",
    "source_id": _SOURCE,
    "line_no": "event_id + 1",
    "ts": _TS,
    "kind": "CASE WHEN event_id % 101 = 7 THEN 'bad' WHEN event_id % 103 = 9 THEN 'skip' ELSE 'event' END",
    "log_type": "CASE WHEN user_id % 3 = 1 AND event_id % 2 = 1 THEN 'app_log' ELSE 'web_access' END",
    "host": _HOST,
    "f_src_ip": (
        "CASE WHEN user_id % 5 = 0 THEN '10.1.' ELSE '198.51.' END || CAST(user_id % 251 AS STRING) || '.' || "
        "CAST(user_id % 241 AS STRING)"
    ),
    "f_user": "CASE WHEN user_id % 7 = 0 THEN '-' ELSE 'user' || CAST(user_id AS STRING) END",
    "f_method": "CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END",
    "f_path": (
        "CASE {k} % 10 WHEN 0 THEN '/.git/config' WHEN 1 THEN '/up/Shell.php' "
        "ELSE '/p' || CAST({k} % 10 AS STRING) END"
    ),
    "f_query": (
        "CASE {k} % 7 WHEN 0 THEN 'id=1 UNION select 2' WHEN 1 THEN 'cmd=whoami' WHEN 2 THEN 'q=<script>' "
        "ELSE 'p=' || CAST({k} AS STRING) END"
    ),
    "f_status": "CASE event_type WHEN 'error' THEN '401' WHEN 'purchase' THEN '200' ELSE '302' END",
    "f_bytes": "CAST(CAST(round(value * 100) AS BIGINT) AS STRING)",
    "f_ua": (
        "CASE {k} % 20 WHEN 0 THEN 'sqlmap/1.' || CAST({k} AS STRING) WHEN 1 THEN 'curl/8.0' "
        "WHEN 2 THEN 'Mozilla/5.0 (X11) Chrome/' || CAST({k} AS STRING) WHEN 3 THEN '-' "
        "WHEN 4 THEN 'tool' || CAST(event_id % 4001 AS STRING) "
        "ELSE 'ua' || CAST({k} % 20 AS STRING) END"
    ),
}
_WEB_JSON = ["src_ip", "user", "method", "path", "query", "status", "bytes", "ua"]

WINDOWS = {
    "case_id": "'c1'",
    "source_id": _SOURCE,
    "line_no": "event_id + 1",
    "ts": _TS,
    "kind": "'event'",
    "log_type": "'windows_event_log'",
    "host": _HOST,
    "f_channel": "CASE WHEN event_type = 'click' THEN 'System' ELSE 'Security' END",
    "f_event_id": (
        "CASE event_type WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4624' WHEN 'click' THEN '7045' "
        "WHEN 'signup' THEN '4688' ELSE CASE {k} % 4 WHEN 0 THEN '4698' WHEN 1 THEN '4702' WHEN 2 THEN '4648' "
        "ELSE '4663' END END"
    ),
    "f_computer": "'PC' || CAST(user_id % 4 AS STRING)",
    "d_TargetUserName": (
        "CASE WHEN user_id % 11 = 0 THEN 'PC' || CAST(user_id AS STRING) || '$' WHEN user_id % 13 = 0 THEN '-' "
        "ELSE 'acct' || CAST(user_id AS STRING) END"
    ),
    "d_LogonType": "CAST({k} % 11 AS STRING)",
    "d_IpAddress": (
        "CASE WHEN {k} % 9 = 0 THEN '-' WHEN user_id % 5 = 0 THEN '192.168.7.' || CAST(user_id % 250 AS STRING) "
        "WHEN user_id % 5 = 1 THEN '2001:0DB8:0:0:0:0:0:' || CAST(user_id % 100 AS STRING) "
        "ELSE '203.0.113.' || CAST(user_id % 250 AS STRING) END"
    ),
    "d_SourceNetworkAddress": "CASE WHEN {k} % 9 = 0 THEN '198.51.100.' || CAST(user_id % 40 AS STRING) ELSE '' END",
    "d_SubjectUserName": "'subject' || CAST(user_id % 17 AS STRING)",
    "d_SubjectUserSid": (
        "CASE WHEN {k} % 3 = 0 THEN 's-1-5-21-1-2-' || CAST(user_id AS STRING) WHEN {k} % 3 = 1 THEN 'S-1-5-18' "
        "ELSE 'none' END"
    ),
    "d_sha256": (
        "CASE WHEN {k} % 4 = 0 THEN sha2_hex(CAST(user_id % 60 AS STRING)) ELSE 'unknown' END"
    ),
    "d_TaskName": (
        "CASE {k} % 5 WHEN 0 THEN '\\\\Microsoft\\\\Update' WHEN 1 THEN '\\\\GoogleSync' ELSE '\\\\Job' END "
        "|| CAST({k} AS STRING)"
    ),
    "d_TaskContent": (
        "CASE {k} % 6 WHEN 0 THEN '<Exec><Command> C:\\\\Users\\\\Public\\\\a.exe </Command></Exec>' "
        "WHEN 1 THEN '<Exec><Command>powershell.exe</Command><Arguments>-enc AAAA</Arguments></Exec>' "
        "WHEN 2 THEN '<Exec></Exec>' "
        "ELSE '<Exec><Command>C:\\\\Apps\\\\b' || CAST({k} AS STRING) || '.exe</Command></Exec>' END"
    ),
    "d_ServiceName": "CASE WHEN {k} % 8 = 3 THEN '' ELSE 'svc' || CAST({k} AS STRING) END",
    "d_ImagePath": (
        "CASE {k} % 8 WHEN 0 THEN 'C:\\\\Windows\\\\Temp\\\\x.exe' WHEN 1 THEN 'c:\\\\ProgramData\\\\y.exe' "
        "WHEN 2 THEN 'powershell -w hidden -enc AAA' WHEN 3 THEN '' "
        "ELSE 'C:\\\\Program Files\\\\v' || CAST({k} AS STRING) || '.exe' END"
    ),
    "d_NewProcessName": (
        "CASE {k} % 9 WHEN 0 THEN 'C:\\\\Windows\\\\System32\\\\svchost.exe' WHEN 1 THEN 'C:\\\\Temp\\\\svchost.exe' "
        "WHEN 2 THEN 'C:/Windows/System32/lsasss.exe' WHEN 3 THEN 'C:\\\\Users\\\\u\\\\exploer.exe' "
        "WHEN 4 THEN 'Registry' WHEN 5 THEN '\"C:\\\\Tools\\\\CSRSS.EXE\"' "
        "ELSE 'C:\\\\Tools\\\\app' || CAST({k} AS STRING) || '.exe' END"
    ),
    "d_TargetServerName": (
        "CASE {k} % 6 WHEN 0 THEN 'LOCALHOST' WHEN 1 THEN '-' ELSE 'SRV' || CAST({k} AS STRING) END"
    ),
    "d_ProcessName": (
        "CASE {k} % 3 WHEN 0 THEN 'C:\\\\Windows\\\\System32\\\\lsass.exe' ELSE 'C:\\\\Tools\\\\dump.exe' END"
    ),
    "d_ObjectName": (
        "CASE {k} % 5 WHEN 0 THEN 'HKLM\\\\SAM\\\\Domains' WHEN 1 THEN '\\\\REGISTRY\\\\MACHINE\\\\SECURITY\\\\P' "
        "ELSE 'HKLM\\\\Software' END"
    ),
    "d_AccessMask": "'0x' || CAST({k} AS STRING)",
}

USN = {
    "case_id": "'c1'",
    "source_id": _SOURCE,
    "line_no": "event_id + 1",
    "ts": _TS,
    "kind": "'event'",
    "log_type": "'usn_journal'",
    "host": _HOST,
    "f_reason_hex": (
        "CASE {k} % 6 WHEN 0 THEN '0x00000100' WHEN 1 THEN '0x80000200' WHEN 2 THEN '0x00002000' "
        "WHEN 3 THEN '0x00008000' WHEN 4 THEN '' ELSE '0x00000003' END"
    ),
    "f_path": (
        "CASE {k} % 8 WHEN 0 THEN 'C:\\\\logs\\\\a.LOG' WHEN 1 THEN 'C:\\\\d\\\\noext' "
        "ELSE 'C:\\\\d\\\\f' || CAST({k} AS STRING) || '.Ext' || CAST({k} % 4 AS STRING) END"
    ),
}


def _duck_escape(text: str) -> str:
    # Spark string literals take backslash escapes, standard SQL ones do not
    return text.replace("\\\\", "\\").replace("STRING", "VARCHAR")


def duck_cte(columns: dict[str, str], name: str = "ev", table: str = "events", raw: str | None = None) -> str:
    """The same projection as a common table expression of standard SQL."""
    parts = []
    for alias, expr in columns.items():
        text = _duck_escape(expr).replace("{k}", K_DUCK).replace("sha2_hex(", "sha256(")
        parts.append(f'{text} AS "{alias}"')
    if raw:
        parts.append(f"{raw} AS raw")
    return f"{name} AS (SELECT {', '.join(parts)} FROM {table})"


def _project(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Event columns: keys plainly, values computed once per row as if they were stored."""
    rows = computed_once(rows, {"_k": F.expr(K_SPARK)})

    def expr(text: str) -> str:
        # sha2 takes the digest size as a second argument here
        sha = "sha2(CAST(user_id % 60 AS STRING), 256)"
        return text.replace("{k}", "_k").replace("sha2_hex(CAST(user_id % 60 AS STRING))", sha)

    values = {c: F.expr(expr(e)) for c, e in columns.items() if c[:2] in ("f_", "d_")}
    keys = [F.expr(expr(e)).alias(c) for c, e in columns.items() if c not in values]
    return computed_once(rows, values).select(*keys, *values)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  Its single file is one read task, so small inputs are spread over the cores first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def web_events(spark: SparkSession, sf_dir: str, promoted: bool = True) -> DataFrame:
    """Access-log events; with ``promoted`` false the values only exist inside the JSON text."""
    rows = _project(table(spark, sf_dir, "events"), WEB)
    values = F.struct(*[F.col(f"f_{k}").alias(k) for k in _WEB_JSON])
    rows = rows.withColumns(
        {
            "fields": F.to_json(values),
            "raw": F.concat_ws(" ", "f_src_ip", "f_method", F.concat("f_path", F.lit("?"), "f_query"), "f_status", "f_ua"),
        }
    )
    return rows if promoted else rows.drop(*[f"f_{k}" for k in _WEB_JSON])


WEB_RAW = "concat_ws(' ', f_src_ip, f_method, f_path || '?' || f_query, f_status, f_ua)"


def windows_events(spark: SparkSession, sf_dir: str, promoted: bool = True) -> DataFrame:
    """Decoded Windows events; with ``promoted`` false event data sits in the nested JSON object."""
    rows = _project(table(spark, sf_dir, "events"), WINDOWS)
    top = [c for c in rows.columns if c.startswith("f_")]
    nested = [c for c in rows.columns if c.startswith("d_")]
    values = F.struct(
        *[F.col(c).alias(c[2:]) for c in top], F.struct(*[F.col(c).alias(c[2:]) for c in nested]).alias("data")
    )
    rows = rows.withColumns(
        {"fields": F.to_json(values), "raw": F.concat_ws(" ", "f_event_id", "f_computer", "d_TargetUserName")}
    )
    return rows if promoted else rows.drop(*top, *nested)


WINDOWS_RAW = "concat_ws(' ', f_event_id, f_computer, d_TargetUserName)"


def usn_events(spark: SparkSession, sf_dir: str, promoted: bool = True) -> DataFrame:
    rows = _project(table(spark, sf_dir, "events"), USN)
    values = F.struct(F.col("f_reason_hex").alias("reason_hex"), F.col("f_path").alias("path"))
    rows = rows.withColumns({"fields": F.to_json(values), "raw": F.concat_ws(" ", "f_reason_hex", "f_path")})
    if promoted:
        return rows.withColumns({"x_reason_hex": F.lit(""), "x_path": F.lit("")})
    return rows.drop("f_reason_hex", "f_path")


def source_table(events: DataFrame) -> DataFrame:
    """One row per source, derived from an event table that carries the source attributes."""
    return events.groupBy("case_id", "source_id").agg(F.max("log_type").alias("log_type"), F.max("host").alias("host"))
