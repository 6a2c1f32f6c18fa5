"""Queries of the settings and process listings of Linux hosts.  Lines are printed from the test tables and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.operators.rules import event_rule_hits
from quernlog.plans.adapters import table
from quernlog.plans.registry import query
from quernlog.sources import host_texts
from quernlog.sources.records import to_events

_SRC = "CAST(user_id % 3 AS VARCHAR) AS source_id, event_id + 1 AS line_no"
_ID, _USER = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)"


def _lines(spark: SparkSession, sf: str, raw: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("CAST(user_id % 3 AS STRING) AS source_id", "event_id + 1 AS line_no", f"{raw} AS raw")


def _fields(records: DataFrame, *fields: str) -> DataFrame:
    return records.select("source_id", "line_no", "kind", *[F.col(f"norm.{f}").alias(f) for f in fields])


_EVENT = "CASE WHEN event_id % 7 < {n} THEN 'event' ELSE 'skip' END AS kind"


def _when(n: int, value: str, name: str) -> str:
    return f"CASE WHEN event_id % 7 < {n} THEN {value} END AS {name}"


@query(
    "parse_deleted_programs",
    f"SELECT {_SRC}, {_EVENT.format(n=5)}, {_when(5, 'CAST(user_id AS VARCHAR)', 'pid')}, {_when(5, '''CASE event_id % 7 WHEN 1 THEN '/tmp/a -> b' WHEN 2 THEN '/tmp/x (deleted)' ELSE '/tmp/' || CAST(event_id AS VARCHAR) END''', 'exe')} FROM events",
)
def deleted_programs(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"""CASE event_id % 7 WHEN 0 THEN 'lrwxrwxrwx 1 root root 0 Jan 1 /proc/' || {_USER} || '/exe -> /tmp/' || {_ID} || ' (deleted)'
 WHEN 1 THEN '/proc/' || {_USER} || '/exe  ->  /tmp/a -> b (deleted) ' WHEN 2 THEN '/proc/' || {_USER} || '/exe -> /tmp/x (deleted) (deleted)'
 WHEN 5 THEN '/proc/' || {_USER} || '/exe -> /tmp/x' WHEN 6 THEN '/proc/x/exe -> /tmp/x (deleted)' ELSE '/proc/' || {_USER} || '/exe -> /tmp/' || {_ID} || ' (deleted)' END"""
    return _fields(host_texts.parse_deleted_programs(_lines(spark, sf, raw)), "pid", "exe")


@query(
    "parse_memory_files",
    f"SELECT {_SRC}, {_EVENT.format(n=5)}, {_when(5, 'CAST(user_id AS VARCHAR)', 'pid')}, {_when(5, 'CAST(event_id % 10 AS VARCHAR)', 'fd')}, {_when(5, '''CAST(event_id AS VARCHAR) || ':x' ''', 'memfd_name')} FROM events",
)
def memory_files(spark: SparkSession, sf: str) -> DataFrame:
    name = f"CASE event_id % 7 WHEN 5 THEN 'two words' WHEN 6 THEN '' ELSE {_ID} || ':x' END"
    raw = f"'lr-x------ 1 r /proc/' || {_USER} || '/fd/' || CAST(event_id % 10 AS STRING) || ' -> /memfd:' || {name} || ' (deleted)'"
    return _fields(host_texts.parse_memory_files(_lines(spark, sf, raw)), "pid", "fd", "memfd_name")


@query(
    "parse_process_maps",
    f"SELECT {_SRC}, {_EVENT.format(n=5)}, {_when(5, 'CAST(user_id AS VARCHAR)', 'pid')}, {_when(5, ''''7f' || lower(hex(event_id)) || '-7fff' ''', '''\"range\"''')}, {_when(5, ''''/tmp/lib ' || CAST(event_id AS VARCHAR)''', 'path')}, {_when(5, '''CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END''', 'deleted')} FROM events",
)
def process_maps(spark: SparkSession, sf: str) -> DataFrame:
    end = "CASE event_id % 2 WHEN 0 THEN ' (deleted)' ELSE '' END"
    raw = f"""' /proc/' || {_USER} || '/maps:7f' || CASE event_id % 7 WHEN 6 THEN 'G' ELSE lower(hex(event_id)) END || '-7fff' ||
 CASE event_id % 7 WHEN 5 THEN '' ELSE ' r-xp  00000 08:01 77 /tmp/lib ' || {_ID} || {end} END"""
    return _fields(host_texts.parse_process_maps(_lines(spark, sf, raw)), "pid", "range", "path", "deleted")


@query(
    "parse_deleted_files",
    f"SELECT {_SRC}, {_EVENT.format(n=5)}, {_when(5, 'CAST(user_id AS VARCHAR)', 'pid')}, {_when(5, ''''0' ''', 'nlink')}, {_when(5, '''CASE event_id % 7 WHEN 1 THEN '/tmp/short' ELSE '/tmp/a  ' || CAST(event_id AS VARCHAR) || ' (deleted)' END''', 'name')} FROM events",
)
def deleted_files(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"""CASE event_id % 7 WHEN 5 THEN 'COMMAND PID USER FD TYPE DEVICE SIZE/OFF NLINK NODE NAME' WHEN 6 THEN 'sh 1 root 3r REG'
 WHEN 1 THEN 'sh ' || {_USER} || ' root 3r REG 8,1 10 0 /tmp/short' ELSE 'sh ' || {_USER} || ' root  3r REG 8,1 10 0 99 /tmp/a  ' || {_ID} || ' (deleted)' END"""
    return _fields(host_texts.parse_deleted_files(_lines(spark, sf, raw)), "pid", "nlink", "name")


@query(
    "parse_scratch_listing",
    f"""WITH e AS (SELECT *, last_value(CASE WHEN event_id % 7 = 6 THEN '/dev/' || CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM events)
SELECT {_SRC}, {_EVENT.format(n=4)}, {_when(4, "CASE event_id % 7 WHEN 1 THEN 'link' ELSE 'f' || CAST(user_id AS VARCHAR) || '.zip' END", 'name')},
 {_when(4, "CASE event_id % 7 WHEN 1 THEN NULL WHEN 2 THEN 'true' ELSE 'false' END", 'is_dir')}, {_when(4, "CASE event_id % 7 WHEN 1 THEN 'b c' END", 'link_target')}, {_when(4, 'd', '"dir"')} FROM e""",
)
def scratch_listing(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"""CASE event_id % 7 WHEN 6 THEN '== /dev/' || {_ID} || ' ==' WHEN 5 THEN 'total 8' WHEN 4 THEN 'drwxr-xr-x 2 root root 40 Jan 1 10:00 ..'
 WHEN 1 THEN 'lrwxrwxrwx 1 root root 7 Jan 1 10:00 my link -> b c' WHEN 2 THEN 'drwxr-xr-x 2 root root 40 Jan 1 10:00 f' || {_USER} || '.zip'
 ELSE '-rw-r--r-- 1 root root 9 Jan  1 10:00 f' || {_USER} || '.zip' END"""
    return _fields(host_texts.parse_scratch_listing(_lines(spark, sf, raw), chunk=500), "name", "is_dir", "link_target", "dir")


@query(
    "parse_device_rules",
    f"""SELECT {_SRC}, {_EVENT.format(n=5)}, {_when(5, "CASE WHEN event_id % 7 IN (1, 2, 3) THEN 'true' ELSE 'false' END", 'has_exec')},
 {_when(5, "CASE event_id % 7 WHEN 1 THEN '/dev/shm/' || CAST(event_id AS VARCHAR) || ' two, 2' END", 'run')}, {_when(5, "CASE event_id % 7 WHEN 2 THEN 'usb_id' END", 'import_program')}, {_when(5, "CASE event_id % 7 WHEN 3 THEN '/bin/x' END", '"program"')} FROM events""",
)
def device_rules(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"""CASE event_id % 7 WHEN 5 THEN '  # note' WHEN 6 THEN ' ' WHEN 1 THEN 'ACTION=="add", RUN+="/dev/shm/' || {_ID} || '", RUN{{program}}="two, 2"'
 WHEN 2 THEN 'IMPORT{{program}}="usb_id"' WHEN 3 THEN 'KERNEL=="sd*", PROGRAM:="/bin/x", NAME="y"' WHEN 4 THEN 'PROGRAM=="/bin/x", RUN="open' ELSE 'SUBSYSTEM=="usb"' END"""
    return _fields(host_texts.parse_device_rules(_lines(spark, sf, raw)), "has_exec", "run", "import_program", "program")


@query(
    "parse_authentication_rules",
    f"""SELECT {_SRC}, {_EVENT.format(n=5)}, {_when(5, "CASE event_id % 7 WHEN 1 THEN NULL WHEN 2 THEN '[success=1 default=ignore]' WHEN 3 THEN '[open' ELSE 'optional' END", 'control')},
 {_when(5, "CASE event_id % 7 WHEN 1 THEN NULL WHEN 3 THEN 'a]x.so' ELSE 'pam_exec.so' END", '"module"')}, {_when(5, "CASE event_id % 7 WHEN 0 THEN 'seteuid  /tmp/' || CAST(event_id AS VARCHAR) WHEN 3 THEN 'y.so' END", 'args')},
 {_when(5, "CASE event_id % 7 WHEN 1 THEN NULL WHEN 3 THEN 'false' ELSE 'true' END", 'is_pam_exec')}, {_when(5, "CASE event_id % 7 WHEN 1 THEN 'common-auth' END", 'target')} FROM events""",
)
def authentication_rules(spark: SparkSession, sf: str) -> DataFrame:
    raw = f"""CASE event_id % 7 WHEN 5 THEN '# auth x y' WHEN 6 THEN '-session optional pam_x.so' WHEN 0 THEN 'auth  optional pam_exec.so seteuid  /tmp/' || {_ID} || ' '
 WHEN 1 THEN '@include common-auth' WHEN 2 THEN 'auth [success=1 default=ignore] pam_exec.so' WHEN 3 THEN 'auth [open a]x.so y.so' ELSE 'session optional pam_exec.so' END"""
    return _fields(host_texts.parse_authentication_rules(_lines(spark, sf, raw)), "control", "module", "args", "is_pam_exec", "target")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """A unit file of nine lines for each customer."""
    name = "CAST(c_custkey AS STRING)"
    lines = [
        "'Stray=1'", "'[Unit]'", "'Description = ' || c_name", "'# [Service]'", "'[Service]'", f"'ExecStart=/tmp/' || {name} || ' \\\\'",
        "'  --loud'", "CASE WHEN c_custkey % 3 = 0 THEN 'ExecStart=/bin/true=1' ELSE 'User=' || c_mktsegment END", "'[Install]'", "'WantedBy=multi-user.target'",
    ]
    rows = table(spark, sf, "customer").selectExpr("c_custkey", f"posexplode(array({', '.join(lines)})) AS (place, raw)")
    return rows.selectExpr("concat('etc/', c_custkey, '.service') AS source_id", "CAST(place + 1 AS BIGINT) AS line_no", "raw")


@query(
    "parse_units",
    """SELECT 'etc/' || CAST(c_custkey AS VARCHAR) || '.service' AS source_id, 1::BIGINT AS line_no, CAST(c_custkey AS VARCHAR) || '.service' AS unit, c_name AS description,
 '/tmp/' || CAST(c_custkey AS VARCHAR) || ' --loud' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '/bin/true=1' ELSE '' END AS exec_start,
 CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS "user", 'multi-user.target' AS wanted_by, 'Install|Service|Unit' AS sections FROM customer""",
)
def units(spark: SparkSession, sf: str) -> DataFrame:
    recs = host_texts.parse_units(_units(spark, sf))
    return recs.select(
        "source_id", "line_no", "norm.unit", "norm.description", "norm.exec_start", "norm.user", "norm.wanted_by", F.array_join("norm.sections", "|").alias("sections")
    )


@query(
    "rule_scan_units",
    """SELECT 'linux-systemd-suspicious-path' AS rule_id, 'etc/' || CAST(c_custkey AS VARCHAR) || '.service' AS source_id, 1::BIGINT AS line_no FROM customer""",
)
def rule_scan_units(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that fire on parsed unit files: all of them start a program in a scratch directory."""
    records = host_texts.parse_units(_units(spark, sf))
    sources = records.select(
        F.lit("c").alias("case_id"), "source_id", F.lit("UTC").alias("tz"), F.lit("systemd_unit").alias("log_type"),
        F.lit("systemd_unit").alias("artifact_type"), F.lit("h").alias("host"),
    )
    return event_rule_hits(to_events(records, sources)).select("rule_id", "source_id", "line_no")


@query(
    "parse_shell_settings",
    """SELECT 'x/Persistence/home/' || c_mktsegment || '/' || CAST(c_custkey AS VARCHAR) AS source_id, c_mktsegment AS owner, 7::BIGINT AS line_count, 5::BIGINT AS non_comment_lines,
 'export LD_PRELOAD=/tmp/' || CAST(c_custkey AS VARCHAR) || chr(10) || 'P_2=$P:/x=1' AS exports, 'alias ll=ls -l ' || c_name AS aliases FROM customer""",
)
def shell_settings(spark: SparkSession, sf: str) -> DataFrame:
    lines = ["'# export A=1'", "' export LD_PRELOAD=/tmp/' || c_custkey", "''", "'alias ll=ls -l ' || c_name || ' '", "'P_2=$P:/x=1'", "'if [ 1 = 1 ]'", "'9A=1'"]
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment", f"posexplode(array({', '.join(lines)})) AS (place, raw)")
    files = rows.selectExpr("concat('x/Persistence/home/', c_mktsegment, '/', c_custkey) AS source_id", "CAST(place + 1 AS BIGINT) AS line_no", "raw")
    return host_texts.parse_shell_settings(files).select(
        "source_id", "norm.owner", "norm.line_count", "norm.non_comment_lines", "norm.exports", "norm.aliases"
    )
