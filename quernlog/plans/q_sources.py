"""Ingest queries.  Log lines are printed from the test tables and parsed back; the SQL reads the tables directly."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.data.descriptors import LINUX_DPKG, PSHISTORY, RAW_TEXT, TOMCAT_CATALINA
from quernlog.operators.search import line_range
from quernlog.sources import access_log, descriptors, file_lists, linux_logs, packages, snapshots
from quernlog.sources.lines import decode_bytes, read_lines, sniff_text, split_lines, store_lines, stored_range
from quernlog.sources.records import canonical_records, to_events
from quernlog.plans.adapters import K_DUCK, K_SPARK, table
from quernlog.plans.registry import query
from quernlog.session import ensure_checkpoint_dir


def _lines(spark: SparkSession, sf: str, raw: str, name: str = "events", key: str = "event_id", source: str = "user_id % 3") -> DataFrame:
    """Numbered lines printed from a table: one per row, sources by ``source``."""
    text = raw.replace("{k}", K_SPARK)
    return table(spark, sf, name).selectExpr(
        f"CAST({source} AS STRING) AS source_id", f"{key} + 1 AS line_no", f"{text} AS raw"
    )


def _us(column: str) -> Column:
    return F.unix_micros(column).alias("ts")


_SRC = "CAST(user_id % 3 AS VARCHAR) AS source_id, event_id + 1 AS line_no"
_SEC = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000"


# ---- physical lines -------------------------------------------------------------------------------


@query(
    "lines_of_documents",
    r"""WITH d AS (SELECT doc_id, string_split_regex(text || chr(13) || chr(10) || 'end', '\r\n|\n|\r') AS parts FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS source_id, unnest(range(1, len(parts) + 1)) AS line_no, md5(unnest(parts)) AS digest FROM d""",
)
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit("\r\nend")))
    return split_lines(docs, "doc_id", "text").select("source_id", "line_no", F.md5("raw").alias("digest"))


@query(
    "lines_read_back",
    r"""WITH d AS (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS raw FROM d) SELECT CAST(doc_id AS VARCHAR) AS source_id, line_no, raw FROM l WHERE line_no BETWEEN 2 AND 5 AND NOT (raw = '' AND line_no = (SELECT max(m.line_no) FROM l m WHERE m.doc_id = l.doc_id))""",
)
def read_back(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_lines(table(spark, sf, "documents"), "doc_id", "text")
    return line_range(rows, None, 2, 5).select("source_id", "line_no", "raw")


@query(
    "lines_stored_range",
    """WITH n AS (SELECT coalesce(source, 'none') AS source, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS line_no,
  regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS raw FROM documents)
SELECT source, line_no, md5(raw) AS digest FROM n WHERE line_no BETWEEN 3 AND 40""",
)
def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One text file per source, numbered once, stored with its index, and a range of lines read back."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/lines-{uuid.uuid4().hex}"
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("value")
    docs = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", line)
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(f"{place}/files")
    store_lines(read_lines(spark, f"{place}/files"), place)
    found = stored_range(spark, place, None, 3, 40)
    return found.select(F.regexp_extract("source_id", "source=([^/]*)/", 1).alias("source"), "line_no", F.md5("raw").alias("digest"))


@query("lines_decoded", "SELECT doc_id, md5(text) AS digest FROM documents")
def decoded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(decode_bytes(F.encode("text", "UTF-8"))).alias("digest")
    )


@query("files_sniffed", "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS INTEGER) AS is_text FROM documents")
def sniffed(spark: SparkSession, sf: str) -> DataFrame:
    # every third text gets a NUL in front
    content = F.encode(F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\u0000"), "text")).otherwise(F.col("text")), "UTF-8")
    return table(spark, sf, "documents").select("doc_id", sniff_text(content).cast("int").alias("is_text"))


# ---- access log -----------------------------------------------------------------------------------

_ACCESS = (
    "CASE WHEN event_id % 53 = 1 THEN '' WHEN event_id % 53 = 2 THEN 'not a log line' ELSE "
    "'198.51.100.' || CAST(user_id % 250 AS STRING) || ' - ' || CASE WHEN user_id % 4 = 0 THEN '-' ELSE 'u' || CAST(user_id AS STRING) END || "
    "' [' || date_format(ts, 'dd/MMM/yyyy:HH:mm:ss') || ' +0000] \"' || CASE WHEN event_type = 'view' THEN 'GET /p' || CAST({k} AS STRING) || '?q=' || CAST(event_id AS STRING) || ' HTTP/1.1' "
    "WHEN event_type = 'error' THEN '-' ELSE 'POST /f' END || '\" ' || CASE WHEN event_id % 59 = 4 THEN '20' ELSE '200' END || ' ' || "
    "CAST(CAST(round(value * 100) AS BIGINT) AS STRING) || ' \"-\" \"ua ' || CAST({k} % 5 AS STRING) || '\"' || "
    "CASE WHEN {k} % 3 = 0 THEN ' \"203.0.113.7, 10.0.0.1\"' WHEN {k} % 3 = 1 THEN ' tail' ELSE '' END END"
)


@query(
    "parse_access_log",
    f"""WITH e AS (SELECT *, {K_DUCK} AS k, CASE WHEN event_id % 53 = 1 THEN 'skip' WHEN event_id % 53 = 2 OR event_id % 59 = 4 THEN 'bad' ELSE 'event' END AS kind FROM events)
SELECT {_SRC}, kind, CASE WHEN kind = 'event' THEN {_SEC} END AS ts, CASE WHEN kind = 'event' THEN '198.51.100.' || CAST(user_id % 250 AS VARCHAR) END AS src_ip,
 CASE WHEN kind = 'event' AND user_id % 4 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS "user",
 CASE WHEN kind = 'event' AND event_type = 'view' THEN '/p' || CAST(k AS VARCHAR) WHEN kind = 'event' AND event_type <> 'error' THEN '/f' END AS path,
 CASE WHEN kind = 'event' AND event_type = 'view' THEN 'q=' || CAST(event_id AS VARCHAR) END AS query,
 CASE WHEN kind = 'event' THEN CAST(round(value * 100) AS BIGINT) END AS bytes,
 CASE WHEN kind = 'event' AND k % 3 = 0 THEN '203.0.113.7, 10.0.0.1' END AS xff, CASE WHEN kind = 'event' AND k % 3 = 1 THEN 'tail' END AS trailing FROM e""",
)
def parse_access(spark: SparkSession, sf: str) -> DataFrame:
    recs = access_log.parse_access_log(_lines(spark, sf, _ACCESS))
    return recs.select(
        "source_id", "line_no", "kind", _us("dt_local"), *[f"norm.{c}" for c in ("src_ip", "user", "path", "query", "bytes", "xff")],
        "norm.extras.trailing",
    )


@query(
    "access_log_to_events",
    f"""SELECT {_SRC}, CASE user_id % 3 WHEN 0 THEN {_SEC} - 28800000000 WHEN 1 THEN {_SEC} + 12600000000 END AS ts,
 '198.51.100.' || CAST(user_id % 250 AS VARCHAR) AS src_ip FROM events WHERE event_id % 53 NOT IN (1, 2) AND event_id % 59 <> 4""",
)
def access_events(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf, _ACCESS)
    zones = F.when(F.col("source_id") == "0", "Asia/Shanghai").when(F.col("source_id") == "1", "UTC-3:30").otherwise("unknown")
    sources = lines.select("source_id").distinct().select(
        F.lit("c1").alias("case_id"), "source_id", zones.alias("tz"), F.lit("web_access").alias("log_type"),
        F.lit("").alias("artifact_type"), F.lit("h").alias("host"),
    )
    rows = to_events(access_log.parse_access_log(lines), sources).filter("kind = 'event'")
    return rows.select("source_id", "line_no", _us("ts"), F.get_json_object("fields", "$.src_ip").alias("src_ip"))


# ---- descriptors ----------------------------------------------------------------------------------

_OSRC = "CAST(o_custkey % 3 AS VARCHAR) AS source_id, o_orderkey + 1 AS line_no"
_ORDER = {"name": "orders", "key": "o_orderkey", "source": "o_custkey % 3"}


@query(
    "parse_descriptor_regex",
    f"SELECT {_OSRC}, CASE WHEN o_custkey % 11 = 0 THEN 'bad' ELSE 'event' END AS kind, CASE WHEN o_custkey % 11 <> 0 THEN epoch_us(o_orderdate) END AS ts, CASE WHEN o_custkey % 11 <> 0 THEN o_orderstatus END AS action, CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END AS message FROM orders",
)
def regex_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = "date_format(o_orderdate, CASE WHEN o_custkey % 11 = 0 THEN 'yyyy/MM/dd HH:mm:ss' ELSE 'yyyy-MM-dd HH:mm:ss' END) || ' ' || o_orderstatus || ' ' || o_orderpriority"
    recs = descriptors.parse_lines(_lines(spark, sf, raw, **_ORDER), LINUX_DPKG)
    return recs.select("source_id", "line_no", "kind", _us("dt_local"), *[F.to_json("norm").alias("_j")]).select(
        "source_id", "line_no", "kind", "ts", F.get_json_object("_j", "$.action").alias("action"), F.get_json_object("_j", "$.message").alias("message")
    )


_JSON = {"kind": "json", "field_map": {"t": "ts_raw", "st": "status"}, "ts_field": "t", "ts_formats": ["%d/%b/%Y %H:%M:%S"]}


@query(
    "parse_descriptor_json",
    f"SELECT {_OSRC}, CASE WHEN o_custkey % 13 = 0 THEN 'bad' ELSE 'event' END AS kind, CASE WHEN o_custkey % 13 <> 0 THEN epoch_us(o_orderdate) END AS ts, CASE WHEN o_custkey % 13 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_custkey % 13 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer FROM orders",
)
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = "to_json(named_struct('t', date_format(o_orderdate, 'dd/MMM/yyyy HH:mm:ss'), 'st', o_orderstatus, 'n', named_struct('cust', o_custkey))) || CASE WHEN o_custkey % 13 = 0 THEN ' {}' ELSE '' END"
    recs = descriptors.parse_lines(_lines(spark, sf, raw, **_ORDER), _JSON)
    return recs.withColumn("_j", F.to_json("norm")).select(
        "source_id", "line_no", "kind", _us("dt_local"), F.get_json_object("_j", "$.status").alias("status"),
        F.get_json_object("_j", "$.extras.n.cust").alias("customer"),
    )


@query(
    "parse_descriptor_csv",
    f"SELECT {_OSRC}, 'event' AS kind, epoch_us(o_orderdate) AS ts, o_orderstatus || '\"' || ', x' AS note FROM orders",
)
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') || ',\"' || o_orderstatus || '\"\", x\"'"
    rows = _lines(spark, sf, raw, **_ORDER)
    heads = rows.select("source_id").distinct().select("source_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("t,note").alias("raw"))
    desc = {"kind": "csv", "field_map": {"t": "ts_raw", "note": "message"}, "ts_field": "t", "ts_formats": ["%Y-%m-%d %H:%M:%S"]}
    recs = descriptors.parse_lines(rows.unionByName(heads), desc).filter("kind <> 'skip'")
    return recs.select("source_id", "line_no", "kind", _us("dt_local"), F.get_json_object(F.to_json("norm"), "$.message").alias("note"))


@query(
    "parse_multiline_blocks",
    f"""WITH e AS (SELECT user_id % 3 AS s, event_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS b FROM events),
g AS (SELECT s, b, min(event_id) AS first_id, arg_min(ts, event_id) AS ts, CAST(count(*) - 1 AS BIGINT) AS continuation_lines FROM e WHERE b > 0 GROUP BY s, b)
SELECT CAST(s AS VARCHAR) AS source_id, first_id + 1 AS line_no, 'event' AS kind, {_SEC} + CAST(floor((epoch_us(ts) % 1000000) / 1000) AS BIGINT) * 1000 AS ts, continuation_lines FROM g
UNION ALL SELECT CAST(s AS VARCHAR), event_id + 1, 'bad', NULL, 0 FROM e WHERE b = 0""",
)
def multiline(spark: SparkSession, sf: str) -> DataFrame:
    raw = "CASE WHEN event_type = 'error' THEN date_format(ts, 'dd-MMM-yyyy HH:mm:ss.SSS') || ' ERROR a.B - m' ELSE '  at ' || event_type END"
    recs = descriptors.parse_lines(_lines(spark, sf, raw), TOMCAT_CATALINA)
    return recs.select("source_id", "line_no", "kind", _us("dt_local"), "continuation_lines")


def _history(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.col("lang").alias("source_id"), F.col("doc_id").alias("line_no"), F.regexp_replace(text, "[\n\r\t]", " ").alias("raw")
    )
    recs = descriptors.parse_lines(rows, PSHISTORY).filter("kind = 'event'")
    return recs.select("line_no", F.md5(F.get_json_object(F.to_json("norm"), "$.cmdline")).alias("digest"))


@query("parse_command_history_whole", "SELECT doc_id AS line_no, md5(trim(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' '))) AS digest FROM documents WHERE trim(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' ')) <> ''")
def whole_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, F.col("text"))


# ---- Linux logs -----------------------------------------------------------------------------------

_MSG = (
    "CASE event_type WHEN 'error' THEN 'Failed password for invalid user u' || CAST(user_id AS STRING) || ' from 203.0.113.' || CAST(user_id % 200 AS STRING) || ' port 1' "
    "WHEN 'purchase' THEN 'Accepted publickey for u' || CAST(user_id AS STRING) || ' from 203.0.113.' || CAST(user_id % 200 AS STRING) "
    "WHEN 'view' THEN 'pam_unix(sshd:session): session opened for user u' || CAST(user_id AS STRING) ELSE 'Disconnected' END"
)
_ACT = (
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'session_opened' END AS action, "
    "CASE WHEN event_type IN ('error', 'purchase', 'view') THEN 'u' || CAST(user_id AS VARCHAR) END AS \"user\", "
    "CASE WHEN event_type IN ('error', 'purchase') THEN '203.0.113.' || CAST(user_id % 200 AS VARCHAR) END AS src_ip"
)
# stamps without a year, collected on 15 January: later days belong to the year before
_YEARLESS = f"CASE WHEN day(ts) > 15 THEN epoch_us(ts - INTERVAL 1 YEAR) ELSE epoch_us(ts) END"
_ROLLED = f"CAST(floor(({_YEARLESS}) / 1000000) AS BIGINT) * 1000000 AS ts, CAST(day(ts) > 15 AS INTEGER) AS rolled"


def _acted(recs: DataFrame) -> DataFrame:
    return recs.filter("kind = 'event'").select(
        "source_id", "line_no", F.unix_micros(F.coalesce("ts_direct", "dt_local")).alias("ts"),
        *[f"norm.{c}" for c in ("action", "user", "src_ip")],
        *([F.col("norm.year_rollover").cast("int").alias("rolled")] if "year_rollover" in recs.schema["norm"].dataType.names else []),
    )


@query("parse_auth_log", f"SELECT {_SRC}, {_ROLLED}, {_ACT} FROM events")
def auth_log(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"date_format(ts, 'MMM') || ' ' || lpad(CAST(day(ts) AS STRING), 2, ' ') || date_format(ts, ' HH:mm:ss') || ' web1 sshd[' || CAST(user_id AS STRING) || ']: ' || {_MSG}"
    return _acted(linux_logs.parse_syslog(_lines(spark, sf, raw), "auth_log", "2024-01-15", auth=True))


@query("parse_syslog_iso", f"SELECT {_SRC}, epoch_us(date_trunc('millisecond', ts)) - 28800000000 AS ts, {_ACT}, CAST(NULL AS INTEGER) AS rolled FROM events")
def syslog_iso(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSS') || '+0800 web1 sshd: ' || {_MSG}"
    return _acted(linux_logs.parse_syslog(_lines(spark, sf, raw), "messages"))


@query("parse_journal_iso", f"SELECT {_SRC}, {_SEC} - 19800000000 AS ts, {_ACT} FROM events")
def journal_iso(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss') || '+0530 web1 sshd[9]: ' || {_MSG}"
    return _acted(linux_logs.parse_journal_iso(_lines(spark, sf, raw)))


@query("parse_journal_short", f"SELECT {_SRC}, {_ROLLED}, {_ACT} FROM events")
def journal_short(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"CASE WHEN user_id % 2 = 0 THEN CAST(month(ts) AS STRING) || '月' ELSE date_format(ts, 'MMM') END || ' ' || CAST(day(ts) AS STRING) || date_format(ts, ' HH:mm:ss') || ' web1 sshd: ' || {_MSG}"
    return _acted(linux_logs.parse_journal_short(_lines(spark, sf, raw), collected="2024-01-15"))


@query("parse_login_records", f"SELECT {_SRC}, {_SEC} AS ts, 'u' || CAST(user_id AS VARCHAR) AS \"user\", '203.0.113.' || CAST(user_id % 200 AS VARCHAR) AS from_host, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS end_text FROM events")
def logins(spark: SparkSession, sf: str) -> DataFrame:
    stamp = "'Mon ' || date_format(ts, 'MMM') || ' ' || CAST(day(ts) AS STRING) || date_format(ts, ' HH:mm:ss yyyy')"
    raw = f"'u' || CAST(user_id AS STRING) || ' pts/0 203.0.113.' || CAST(user_id % 200 AS STRING) || ' ' || {stamp} || CASE WHEN event_type = 'view' THEN ' - ' || {stamp} || ' (00:00)' ELSE '' END"
    recs = linux_logs.parse_last(_lines(spark, sf, raw)).filter("kind = 'event'")
    return recs.select("source_id", "line_no", _us("dt_local"), "norm.user", "norm.from_host", F.col("norm.end").alias("end_text"))


@query("parse_lastlog", f"SELECT {_SRC}, CASE WHEN event_type <> 'view' THEN {_SEC} - 28800000000 END AS ts, 'u' || CAST(user_id AS VARCHAR) AS \"user\", CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END AS never FROM events")
def lastlog(spark: SparkSession, sf: str) -> DataFrame:
    raw = "'u' || CAST(user_id AS STRING) || CASE WHEN event_type = 'view' THEN '   **Never logged in**' ELSE ' pts/1 10.0.0.1 Mon ' || date_format(ts, 'MMM') || ' ' || CAST(day(ts) AS STRING) || date_format(ts, ' HH:mm:ss') || ' +0800 ' || date_format(ts, 'yyyy') END"
    recs = linux_logs.parse_lastlog(_lines(spark, sf, raw)).filter("kind = 'event'")
    return recs.select("source_id", "line_no", _us("ts_direct"), "norm.user", "norm.never")


@query("parse_yum_log", f"SELECT {_SRC}, {_ROLLED}, 'Installed: p' || CAST(user_id AS VARCHAR) AS message FROM events")
def yum(spark: SparkSession, sf: str) -> DataFrame:
    raw = "date_format(ts, 'MMM') || ' ' || CAST(day(ts) AS STRING) || date_format(ts, ' HH:mm:ss') || ' Installed: p' || CAST(user_id AS STRING)"
    recs = linux_logs.parse_yum(_lines(spark, sf, raw), "2024-01-15").filter("kind = 'event'")
    return recs.select("source_id", "line_no", _us("dt_local"), F.col("norm.year_rollover").cast("int").alias("rolled"), "norm.message")


# ---- snapshots ------------------------------------------------------------------------------------

_REMOTE = "CASE WHEN user_id % 2 = 0 THEN '203.0.113.' || CAST(user_id % 200 AS STRING) ELSE '::ffff:198.51.100.' || CAST(user_id % 200 AS STRING) END"
_REMOTE_DUCK = _REMOTE.replace("STRING", "VARCHAR")


@query("parse_ss", f"SELECT {_SRC}, {_REMOTE_DUCK} AS remote_addr, CAST(event_id % 9000 AS VARCHAR) AS remote_port, CASE WHEN event_type = 'view' THEN 'sshd' END AS process_name FROM events")
def ss(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"'tcp   ESTAB 0 0 10.0.0.1%eth0:22   [' || {_REMOTE} || ']:' || CAST(event_id % 9000 AS STRING) || CASE WHEN event_type = 'view' THEN ' users:((\"sshd\",pid=7,fd=3))' ELSE '' END"
    return snapshots.parse_ss(_lines(spark, sf, raw)).select("source_id", "line_no", "norm.remote_addr", "norm.remote_port", "norm.process_name")


@query("parse_netstat", f"SELECT {_SRC}, CASE WHEN event_type <> 'view' THEN 'ESTABLISHED' END AS state, {_REMOTE_DUCK} AS remote_addr, CAST(user_id AS VARCHAR) AS pid FROM events")
def netstat(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"CASE WHEN event_type = 'view' THEN 'udp' ELSE 'tcp' END || ' 0 0 10.0.0.1:22 ' || {_REMOTE} || ':55 ' || CASE WHEN event_type = 'view' THEN '' ELSE 'ESTABLISHED ' END || CAST(user_id AS STRING) || '/prog'"
    return snapshots.parse_netstat(_lines(spark, sf, raw)).select("source_id", "line_no", "norm.state", "norm.remote_addr", "norm.pid")


@query(
    "parse_windows_netstat",
    f"""WITH e AS (SELECT *, sum(CASE WHEN event_type NOT IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS b FROM events),
o AS (SELECT user_id % 3 AS s, b, arg_max('p' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_type = 'view') AS p, arg_min('s' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_type = 'click') AS v FROM e WHERE b > 0 GROUP BY 1, 2)
SELECT {_SRC}, CAST(user_id AS VARCHAR) AS pid, o.p AS process_name, o.v AS service FROM e JOIN o ON o.s = user_id % 3 AND o.b = e.b WHERE event_type NOT IN ('view', 'click')""",
)
def windows_netstat(spark: SparkSession, sf: str) -> DataFrame:
    raw = "CASE event_type WHEN 'view' THEN ' [p' || CAST(event_id AS STRING) || ']' WHEN 'click' THEN '  s' || CAST(event_id AS STRING) ELSE '  TCP  10.0.0.1:445  203.0.113.1:50  ESTABLISHED  ' || CAST(user_id AS STRING) END"
    recs = snapshots.parse_windows_netstat(_lines(spark, sf, raw), chunk=2000).filter("kind = 'event'")
    return recs.select("source_id", "line_no", "norm.pid", "norm.process_name", "norm.service")


_CT_RAW = (
    "CASE WHEN event_type = 'click' THEN 'short line' ELSE 'tcp 6 ' || CAST(event_id AS STRING) || ' ' || CASE WHEN event_type = 'view' THEN '' ELSE 'SYN_SENT ' END || "
    "'src=10.0.0.1 dst=203.0.113.' || CAST(user_id % 200 AS STRING) || ' sport=9 dport=' || CAST(event_id % 5000 AS STRING) || ' [UNREPLIED] src=1.1.1.1 dst=2.2.2.2 [X] mark=0' END"
)


@query(
    "parse_conntrack",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS rn FROM events)
SELECT {_SRC}, CASE WHEN event_type <> 'view' THEN 'SYN_SENT' END AS state, '203.0.113.' || CAST(user_id % 200 AS VARCHAR) AS remote_addr, CAST(event_id % 5000 AS VARCHAR) AS dport, 'UNREPLIED X' AS flags
FROM e WHERE event_type <> 'click'""",
)
def conntrack(spark: SparkSession, sf: str) -> DataFrame:
    recs = snapshots.parse_conntrack(_lines(spark, sf, _CT_RAW), chunk=1500).filter("kind = 'event'")
    return recs.select("source_id", "line_no", *[f"norm.{c}" for c in ("state", "remote_addr", "dport", "flags")])


@query(
    "conntrack_summary",
    """WITH e AS (SELECT *, user_id % 3 AS s, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS rn FROM events),
g AS (SELECT s, count(*) AS t, count(CASE WHEN event_type = 'click' THEN 1 END) AS m, count(CASE WHEN event_type <> 'click' THEN 1 END) AS em FROM e GROUP BY 1)
SELECT CAST(s AS VARCHAR) AS source_id, t AS total_lines, m AS malformed_lines, em AS emitted_entries, 0 AS truncated_entries, 'false' AS capped FROM g""",
)
def conntrack_totals(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.conntrack_summary(_lines(spark, sf, _CT_RAW), chunk=1500)


_CSRC = "CAST(c_nationkey AS VARCHAR) AS source_id, c_custkey + 1 AS line_no"
_CUST = {"name": "customer", "key": "c_custkey", "source": "c_nationkey"}


@query("parse_ps", f"SELECT {_CSRC}, c_mktsegment AS account, '/bin/run  ' || c_name AS command FROM customer")
def ps(spark: SparkSession, sf: str) -> DataFrame:
    raw = "c_mktsegment || ' ' || CAST(c_custkey AS STRING) || ' 0.0 0.1 10 20 ? Ss 10:00 0:01 /bin/run  ' || c_name"
    return snapshots.parse_ps(_lines(spark, sf, raw, **_CUST)).select("source_id", "line_no", "norm.account", "norm.command")


@query("parse_process_identity", f"SELECT {_CSRC}, CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END AS exe_missing, CASE WHEN c_custkey % 3 = 1 THEN 'true' ELSE 'false' END AS comm_exe_mismatch FROM customer")
def identity(spark: SparkSession, sf: str) -> DataFrame:
    raw = "CAST(c_custkey AS STRING) || '\\tsh\\tsh -c\\t' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/bin/dash' ELSE '/bin/sh' END"
    return snapshots.parse_process_identity(_lines(spark, sf, raw, **_CUST)).select("source_id", "line_no", "norm.exe_missing", "norm.comm_exe_mismatch")


@query("parse_passwd", f"SELECT {_CSRC}, c_name AS username, CAST(c_custkey % 4 AS VARCHAR) AS uid, CASE WHEN c_custkey % 5 = 0 THEN 'true' END AS empty_password FROM customer WHERE c_custkey % 6 <> 0")
def passwd(spark: SparkSession, sf: str) -> DataFrame:
    raw = "c_name || ':' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'x' END || ':' || CAST(c_custkey % 4 AS STRING) || ':0:g:/h' || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE ':/bin/sh' END"
    recs = snapshots.parse_passwd(_lines(spark, sf, raw, **_CUST)).filter("kind = 'event'")
    return recs.select("source_id", "line_no", "norm.username", "norm.uid", "norm.empty_password")


@query("parse_group", f"SELECT {_CSRC}, c_name AS group_name, c_mktsegment || '|b' AS members FROM customer")
def groups(spark: SparkSession, sf: str) -> DataFrame:
    recs = snapshots.parse_group(_lines(spark, sf, "c_name || ':x:7:' || c_mktsegment || ',,b'", **_CUST))
    return recs.select("source_id", "line_no", F.col("norm.group").alias("group_name"), F.array_join("norm.members", "|").alias("members"))


@query(
    "parse_crontab_sections",
    f"""WITH c AS (SELECT *, max(CASE WHEN c_custkey % 5 = 0 THEN c_custkey END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM customer)
SELECT {_CSRC}, 'Customer#' || lpad(CAST(o AS VARCHAR), 9, '0') AS "user", 'curl ' || c_name AS command FROM c WHERE c_custkey % 5 > 1 AND o IS NOT NULL""",
)
def crontab(spark: SparkSession, sf: str) -> DataFrame:
    raw = "CASE c_custkey % 5 WHEN 0 THEN '===== ' || c_name || ' =====' WHEN 1 THEN 'MAILTO=x' ELSE '*/5 * * * * curl ' || c_name END"
    recs = snapshots.parse_crontab_sections(_lines(spark, sf, raw, **_CUST), chunk=300).filter("kind = 'event'")
    return recs.select("source_id", "line_no", "norm.user", "norm.command")


@query("parse_system_cron", f"SELECT {_CSRC}, '@daily' AS schedule, c_mktsegment AS \"user\", 'run ' || c_name AS command FROM customer")
def system_cron(spark: SparkSession, sf: str) -> DataFrame:
    recs = snapshots.parse_system_cron(_lines(spark, sf, "'@daily ' || c_mktsegment || ' run ' || c_name", **_CUST))
    return recs.select("source_id", "line_no", "norm.schedule", "norm.user", "norm.command")


@query("parse_anacrontab", f"SELECT {_CSRC}, CAST(c_custkey % 30 AS VARCHAR) AS schedule, c_mktsegment AS job_id, 'run ' || c_name AS command FROM customer")
def anacron(spark: SparkSession, sf: str) -> DataFrame:
    recs = snapshots.parse_anacrontab(_lines(spark, sf, "CAST(c_custkey % 30 AS STRING) || ' 5 ' || c_mktsegment || ' run ' || c_name", **_CUST))
    return recs.select("source_id", "line_no", "norm.schedule", "norm.job_id", "norm.command")


@query("parse_cron_spool", f"SELECT {_CSRC}, CASE WHEN c_custkey % 4 = 0 THEN 'bad' ELSE 'event' END AS kind, CASE WHEN c_custkey % 4 <> 0 THEN 'run ' || c_name END AS command FROM customer")
def cron_spool(spark: SparkSession, sf: str) -> DataFrame:
    recs = snapshots.parse_cron_spool(_lines(spark, sf, "CASE WHEN c_custkey % 4 = 0 THEN '5 4' ELSE '5 4 * * 1 run ' || c_name END", **_CUST))
    return recs.select("source_id", "line_no", "kind", "norm.command")


@query(
    "parse_authorized_keys",
    f"""SELECT {_CSRC}, CASE c_custkey % 4 WHEN 0 THEN 256 WHEN 1 THEN 384 END AS key_bits, sha256('AAAA' || CAST(c_custkey AS VARCHAR)) AS blob_sha256,
 CASE c_custkey % 4 WHEN 0 THEN 'no_comment' WHEN 1 THEN NULL WHEN 2 THEN 'unattributable_comment' ELSE 'forced_command placeholder_comment' END AS risk_flags FROM customer""",
)
def keys(spark: SparkSession, sf: str) -> DataFrame:
    blob = "'AAAA' || CAST(c_custkey AS STRING)"
    raw = f"CASE c_custkey % 4 WHEN 0 THEN 'ssh-ed25519 ' || {blob} WHEN 1 THEN 'ecdsa-sha2-nistp384 ' || {blob} || ' a@real' WHEN 2 THEN 'sk-other ' || {blob} || ' admin' ELSE 'command=\"x y\" sk-other ' || {blob} || ' a@localhost' END"
    recs = snapshots.parse_authorized_keys(_lines(spark, sf, raw, **_CUST))
    return recs.select("source_id", "line_no", "norm.key_bits", "norm.blob_sha256", "norm.risk_flags")


# ---- file lists -----------------------------------------------------------------------------------

_USN_RAW = (
    "CAST(event_id * 8 AS STRING) || ',f' || CAST(user_id AS STRING) || '.txt,9,' || CASE {k} % 4 WHEN 0 THEN '0x00000100' WHEN 1 THEN '0x80000200' WHEN 2 THEN '0x00003000' ELSE 'oops' END || "
    "',\"a, b\",' || date_format(ts, 'yyyy/M/d H:mm:ss') || ',0x20,arch,0x1,0x2,0,0,1,2,0,80'"
)
_FLAGS = "CASE {k} % 4 WHEN 0 THEN 'FILE_CREATE' WHEN 1 THEN 'FILE_DELETE|CLOSE' WHEN 2 THEN 'RENAME_OLD_NAME|RENAME_NEW_NAME' END".replace("{k}", K_DUCK)


def _usn(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf, _USN_RAW)
    head = rows.select("source_id").distinct().select("source_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("Usn,n,l,r,t,d,a,b,c,d,e,f,g,h,i,j").alias("raw"))
    return file_lists.parse_usn(rows.unionByName(head))


@query("parse_usn", f"SELECT {_SRC}, CASE WHEN {K_DUCK} % 4 = 3 THEN 'bad' ELSE 'event' END AS kind, CASE WHEN {K_DUCK} % 4 <> 3 THEN {_SEC} END AS ts, {_FLAGS} AS flags FROM events")
def usn(spark: SparkSession, sf: str) -> DataFrame:
    return _usn(spark, sf).filter("kind <> 'skip'").select("source_id", "line_no", "kind", _us("dt_local"), F.array_join("norm.reason_flags", "|").alias("flags"))


@query(
    "usn_summary",
    f"""WITH e AS (SELECT user_id % 3 AS s, event_id, {K_DUCK} % 4 AS r FROM events)
SELECT CAST(s AS VARCHAR) AS source_id, count(*) AS total_rows, count(CASE WHEN r <> 3 THEN 1 END) AS valid_rows, count(CASE WHEN r = 3 THEN 1 END) AS bad_rows, min(CASE WHEN r <> 3 THEN event_id * 8 END) AS first_usn,
 max(CASE WHEN r <> 3 THEN event_id * 8 END) AS last_usn, count(CASE WHEN r = 0 THEN 1 END) AS file_creates, count(CASE WHEN r = 1 THEN 1 END) AS file_deletes, count(CASE WHEN r = 2 THEN 1 END) AS rename_old,
 count(CASE WHEN r = 2 THEN 1 END) AS rename_new, CAST(0 AS BIGINT) AS rows_ts_unresolved FROM e GROUP BY s""",
)
def usn_totals(spark: SparkSession, sf: str) -> DataFrame:
    return file_lists.usn_summary(_usn(spark, sf))


@query(
    "usn_reason_histogram",
    f"""WITH e AS (SELECT user_id % 3 AS s, unnest(string_split({_FLAGS}, '|')) AS reason FROM events), c AS (SELECT s, reason, count(*) AS count FROM e GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS source_id, reason, count, CAST(row_number() OVER (PARTITION BY s ORDER BY count DESC, reason) AS INTEGER) AS rank FROM c""",
)
def usn_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return file_lists.usn_reason_histogram(_usn(spark, sf))


@query(
    "usn_top_files",
    f"""WITH c AS (SELECT user_id % 3 AS s, 'f' || CAST(user_id AS VARCHAR) || '.txt' AS file, count(*) AS count FROM events WHERE {K_DUCK} % 4 <> 3 GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS source_id, file, count, CAST(row_number() OVER (PARTITION BY s ORDER BY count DESC, file) AS INTEGER) AS rank FROM c""",
)
def usn_files(spark: SparkSession, sf: str) -> DataFrame:
    return file_lists.usn_top_files(_usn(spark, sf))


_EXT = "CASE user_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'doc' WHEN 2 THEN 'x' || CAST(user_id AS VARCHAR) END"


def _file_list(spark: SparkSession, sf: str) -> DataFrame:
    raw = "'\"' || CASE WHEN user_id % 5 = 0 THEN 'd' ELSE 'C' END || ':\\\\a, b\\\\n' || CAST(event_id AS STRING) || CASE user_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.doc' WHEN 2 THEN '.x' || CAST(user_id AS STRING) ELSE '' END || '\",' || CAST(event_id AS STRING) || ',' || CAST((unix_seconds(CAST(ts AS TIMESTAMP)) + 11644473600) * 10000000 AS STRING) || ',0,32'"
    rows = _lines(spark, sf, raw)
    head = rows.select("source_id").distinct().select("source_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("Filename,Size,Date Modified,Date Created,Attributes").alias("raw"))
    return file_lists.parse_file_list(rows.unionByName(head))


@query("parse_file_list", f"SELECT {_SRC}, {_SEC} AS ts, event_id AS size_bytes, {_EXT} AS extension, CASE WHEN user_id % 5 = 0 THEN 'D' ELSE 'C' END AS drive FROM events")
def file_list(spark: SparkSession, sf: str) -> DataFrame:
    recs = _file_list(spark, sf).filter("kind = 'event'")
    return recs.select("source_id", "line_no", _us("ts_direct"), "norm.size_bytes", "norm.extension", "norm.drive")


@query(
    "file_list_extensions",
    f"""WITH c AS (SELECT user_id % 3 AS s, coalesce({_EXT}, '(none)') AS extension, count(*) AS count FROM events GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS source_id, extension, count, CAST(row_number() OVER (PARTITION BY s ORDER BY count DESC, extension) AS INTEGER) AS rank FROM c""",
)
def extensions(spark: SparkSession, sf: str) -> DataFrame:
    return file_lists.file_list_extensions(_file_list(spark, sf))


@query("file_list_drives", "SELECT CAST(user_id % 3 AS VARCHAR) AS source_id, CASE WHEN user_id % 5 = 0 THEN 'D' ELSE 'C' END AS drive, count(*) AS count FROM events GROUP BY ALL")
def drives(spark: SparkSession, sf: str) -> DataFrame:
    return file_lists.file_list_drives(_file_list(spark, sf))


@query("file_list_summary", f"SELECT CAST(user_id % 3 AS VARCHAR) AS source_id, count(*) AS total_rows, CAST(0 AS BIGINT) AS bad_rows, count(DISTINCT {_EXT}) AS distinct_extensions FROM events GROUP BY 1")
def file_list_totals(spark: SparkSession, sf: str) -> DataFrame:
    return file_lists.file_list_summary(_file_list(spark, sf))


# ---- packages -------------------------------------------------------------------------------------


@query(
    "package_routes",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'auth_log' WHEN 1 THEN 'usn_journal' WHEN 2 THEN 'systemd_unit' WHEN 3 THEN 'linux_log_file' WHEN 4 THEN 'text_snapshot' ELSE 'unmapped' END AS artifact_type,
 CASE page_id % 6 WHEN 0 THEN 'native' WHEN 1 THEN 'native' WHEN 2 THEN 'native' ELSE 'raw' END AS route, CASE page_id % 6 WHEN 0 THEN 'linux_authlog' WHEN 1 THEN 'usn_csv' WHEN 2 THEN 'linux_systemd' ELSE '' END AS parser FROM pages""",
)
def routes(spark: SparkSession, sf: str) -> DataFrame:
    n = "CAST(page_id AS STRING)"
    rel = f"CASE page_id % 6 WHEN 0 THEN 'Logs/var/log/auth.log' WHEN 1 THEN 'x/usn_journal_' || {n} || '.csv' WHEN 2 THEN 'a/b/' || {n} || '.service' WHEN 3 THEN 'Logs/var/log/app/' || {n} WHEN 4 THEN 'deep/er/' || {n} || '.txt' ELSE 'odd' || {n} END"
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{rel} AS rel_path")
    return packages.route_files(rows).select("page_id", "artifact_type", "route", "parser")


@query("package_zones", "SELECT 'pk' || CAST(n_regionkey AS VARCHAR) AS package, 'Zone/' || CAST(min(n_nationkey) AS VARCHAR) AS tz FROM nation GROUP BY n_regionkey")
def zones(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").selectExpr("'pk' || CAST(n_regionkey AS STRING) AS package", "n_nationkey AS line_no", "'Timezone=Zone/' || CAST(n_nationkey AS STRING) || ' ' AS raw")
    other = rows.withColumns({"raw": F.lit("Host=x"), "line_no": F.col("line_no") - 100})
    return packages.package_zones(rows.unionByName(other))


_STATES = "CASE WHEN doc_id % 7 = 0 THEN 'extra' WHEN doc_id % 7 = 1 THEN 'missing' WHEN doc_id % 7 = 2 THEN 'mismatch' ELSE 'ok' END AS state"


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("rel_path"), F.sha2("text", 256).alias("sha256"))
    r = F.col("doc_id") % 7
    digest = F.when(r == 2, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))
    entry = F.concat(F.upper(digest), F.lit("  C:\\out\\Forensic_1_pc\\d\\"), F.col("doc_id").cast("string"))
    rows = docs.filter(r != 0).select(F.col("doc_id").alias("line_no"), entry.alias("raw"))
    junk = docs.filter(r == 0).select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 2 == 0, "Host=a").otherwise("??").alias("raw"))
    return packages.manifest_entries(rows.unionByName(junk), "Forensic_1_pc"), docs.filter(r != 1)


@query("manifest_states", f"SELECT 'd/' || CAST(doc_id AS VARCHAR) AS rel_path, {_STATES} FROM documents")
def manifest_states(spark: SparkSession, sf: str) -> DataFrame:
    return packages.reconcile(*_manifest(spark, sf))


@query(
    "manifest_summary",
    f"""WITH s AS (SELECT doc_id, {_STATES} FROM documents)
SELECT count(CASE WHEN state = 'ok' THEN 1 END) AS ok, count(CASE WHEN state = 'missing' THEN 1 END) AS missing, count(CASE WHEN state = 'mismatch' THEN 1 END) AS mismatch,
 count(CASE WHEN state = 'extra' THEN 1 END) AS extra, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0 AND doc_id % 2 = 1) AS bad_lines, 0 AS passed FROM s""",
)
def manifest_totals(spark: SparkSession, sf: str) -> DataFrame:
    entries, files = _manifest(spark, sf)
    return packages.reconcile_summary(packages.reconcile(entries, files), entries).withColumn("passed", F.col("passed").cast("int"))


@query(
    "format_fingerprint",
    """WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS line_no, user_id % 2 AS f, event_type FROM events),
s AS (SELECT *, CASE WHEN line_no <= 20 THEN 2 ELSE 1 END AS w, event_type <> 'click' AS ok FROM e WHERE line_no <= 200),
g AS (SELECT source_id, f, sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w) AS c, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS parsed FROM s GROUP BY source_id, f),
h AS (SELECT *, CASE f WHEN 0 THEN c ELSE 1.0 END AS conf FROM g)
SELECT source_id, CASE f WHEN 0 THEN 'dpkg' ELSE 'journal' END AS format_id, round(conf, 6) AS confidence, CASE f WHEN 0 THEN n ELSE parsed END AS sampled, parsed,
 CASE WHEN conf >= 0.9 THEN 'auto' ELSE 'pending_confirm' END AS detect_status FROM h""",
)
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf, "events").withColumn("s", F.col("user_id") % 40)
    good = F.when(F.col("s") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" install x"))).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000 h u: m"))
    )
    rows = events.select(
        F.col("s").cast("string").alias("source_id"),
        F.row_number().over(Window.partitionBy("s").orderBy("event_id")).cast("bigint").alias("line_no"),
        F.when(F.col("event_type") == "click", "junk").otherwise(good).alias("raw"),
    )
    candidates = {
        "access": access_log.parse_access_log, "dpkg": lambda x: descriptors.parse_lines(x, LINUX_DPKG),
        "journal": linux_logs.parse_journal_iso,
    }
    return packages.fingerprint(rows, candidates).withColumn("confidence", F.round("confidence", 6))


@query(
    "canonical_records",
    f"SELECT {_OSRC}, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, o_orderstatus AS action FROM orders",
)
def canonical(spark: SparkSession, sf: str) -> DataFrame:
    raw = "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') || ' ' || o_orderstatus || ' m'"
    lines = _lines(spark, sf, raw, **_ORDER)
    zones_ = lines.select("source_id").distinct().withColumn("tz", F.lit("UTC"))
    out = canonical_records(descriptors.parse_lines(lines, LINUX_DPKG), zones_)
    return out.select("source_id", "line_no", F.get_json_object("record", "$.ts_utc").alias("ts_utc"), F.get_json_object("record", "$.norm.action").alias("action"))


@query("parse_raw_text", "SELECT item_id AS line_no, md5(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS digest FROM benchmark")
def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.lit("b").alias("source_id"), F.col("item_id").alias("line_no"), F.regexp_replace("text", "[\n\r]", " ").alias("raw"))
    return descriptors.parse_lines(rows, RAW_TEXT).select("line_no", F.md5(F.get_json_object(F.to_json("norm"), "$.message")).alias("digest"))
