"""Detector queries over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.operators import chains, cross, host, web
from quernlog.plans.adapters import (
    USN, WEB, WEB_RAW, WINDOWS, WINDOWS_RAW, duck_cte, usn_events, web_events, windows_events,
)
from quernlog.plans.registry import query

EV = duck_cte(WEB, raw=None)
WEB_CTE = f"WITH RECURSIVE {EV}, w AS (SELECT *, {WEB_RAW} AS raw FROM ev WHERE kind = 'event' AND log_type = 'web_access')"
WIN_CTE = f"WITH RECURSIVE {duck_cte(WINDOWS)}, w AS (SELECT *, {WINDOWS_RAW} AS raw FROM ev)"
USN_CTE = f"WITH RECURSIVE {duck_cte(USN)}"


def us(column: str) -> str:
    return f"epoch_us({column})"


def micros(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as microseconds, so that results do not depend on a client's time zone."""
    return df.withColumns({c: F.unix_micros(c) for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- failure-then-success chains ------------------------------------------------------------------

def _chain_sql(cte: str, key: str, fail: str, success: str, keep: str, accept: str, n: int, out: str) -> str:
    return f"""{cte},
r AS (SELECT source_id, {key} AS key, line_no, ts, {fail} AS fail,
        row_number() OVER (PARTITION BY source_id, {key} ORDER BY line_no) AS rn
      FROM w WHERE ({fail} OR {success}) AND {keep}),
walk AS (
  SELECT source_id, key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS fails, CAST(0 AS BIGINT) AS first_line,
         CAST(0 AS BIGINT) AS nth_line, CAST(NULL AS TIMESTAMP) AS nth_ts, CAST(0 AS BIGINT) AS last_line,
         CAST(NULL AS TIMESTAMP) AS last_ts, FALSE AS hit, CAST(0 AS BIGINT) AS line_no, CAST(NULL AS TIMESTAMP) AS ts,
         CAST(0 AS BIGINT) AS h_fails, CAST(0 AS BIGINT) AS h_first, CAST(0 AS BIGINT) AS h_nth,
         CAST(NULL AS TIMESTAMP) AS h_nth_ts, CAST(0 AS BIGINT) AS h_last, CAST(NULL AS TIMESTAMP) AS h_last_ts
  FROM r GROUP BY source_id, key
  UNION ALL
  SELECT source_id, key, rn,
         CASE WHEN fail THEN fails + 1 WHEN ok THEN 0 ELSE fails END,
         CASE WHEN fail AND fails = 0 THEN l WHEN ok THEN 0 ELSE first_line END,
         CASE WHEN fail AND fails + 1 = {n} THEN l WHEN ok THEN 0 ELSE nth_line END,
         CASE WHEN fail AND fails + 1 = {n} THEN t WHEN ok THEN NULL ELSE nth_ts END,
         CASE WHEN fail THEN l WHEN ok THEN 0 ELSE last_line END,
         CASE WHEN fail THEN t WHEN ok THEN NULL ELSE last_ts END,
         ok, l, t, fails, first_line, nth_line, nth_ts, last_line, last_ts
  FROM (
    SELECT s.source_id, s.key, r.rn, r.fail, r.line_no AS l, r.ts AS t, s.fails, s.first_line, s.nth_line, s.nth_ts,
           s.last_line, s.last_ts, (NOT r.fail AND s.fails >= {n} AND ({accept})) AS ok
    FROM walk s JOIN r ON r.source_id = s.source_id AND r.key = s.key AND r.rn = s.rn + 1) q)
SELECT {out} FROM walk WHERE hit"""


_BF_SQL = _chain_sql(
    WEB_CTE, "f_src_ip", "f_status IN ('401','403')", "f_status = '200'", "f_src_ip <> ''",
    "CASE WHEN r.ts IS NOT NULL AND s.nth_ts IS NOT NULL THEN abs(epoch_us(r.ts) - epoch_us(s.nth_ts)) <= 172800000000 "
    "ELSE r.line_no - s.nth_line <= 500 END",
    3,
    "source_id, line_no, epoch_us(ts) AS ts, key AS matched_value, h_fails AS fail_count, h_first AS fail_first_line, "
    "h_nth AS fail_nth_line, CASE WHEN ts IS NOT NULL AND h_nth_ts IS NOT NULL THEN 'seconds' ELSE 'lines' END AS window_basis, "
    "round(CASE WHEN ts IS NOT NULL AND h_nth_ts IS NOT NULL THEN abs(epoch_us(ts) - epoch_us(h_nth_ts)) / 1e6 "
    "ELSE CAST(line_no - h_nth AS DOUBLE) END, 6) AS window_actual, 'strong' AS evidence_grade",
)


def _bruteforce(spark: SparkSession, sf: str, **more: int) -> DataFrame:
    found = chains.bruteforce_chain(
        web_events(spark, sf), fail_threshold=3, window_seconds=172800, window_lines=500, **more
    )
    return rounded(micros(found, "ts"), "window_actual").select(
        "source_id", "line_no", "ts", "matched_value", "fail_count", "fail_first_line", "fail_nth_line",
        "window_basis", "window_actual", "evidence_grade",
    )


@query("detect_bruteforce_chain", _BF_SQL)
def bruteforce(spark: SparkSession, sf: str) -> DataFrame:
    return _bruteforce(spark, sf)


@query("detect_bruteforce_chain_large_groups", _BF_SQL)
def bruteforce_large(spark: SparkSession, sf: str) -> DataFrame:
    """Every client over 20 rows takes the way of oversized groups."""
    return _bruteforce(spark, sf, group_rows=20, chunk=2048)


_AUTH_SQL = _chain_sql(
    WIN_CTE, "f_computer || chr(31) || d_TargetUserName", "f_event_id = '4625'", "f_event_id = '4624'",
    "d_TargetUserName NOT IN ('', '-') AND NOT ends_with(d_TargetUserName, '$')",
    "r.ts IS NULL OR s.last_ts IS NULL OR abs(epoch_us(r.ts) - epoch_us(s.last_ts)) <= 86400000000",
    2,
    "source_id, line_no, epoch_us(ts) AS ts, split_part(key, chr(31), 1) AS computer, split_part(key, chr(31), 2) AS matched_value, "
    "h_fails AS fail_count, h_first AS fail_first_line, h_nth AS fail_nth_line, h_last AS fail_last_line, "
    "round(CASE WHEN ts IS NOT NULL AND h_last_ts IS NOT NULL THEN abs(epoch_us(ts) - epoch_us(h_last_ts)) / 1e6 "
    "ELSE -1.0 END, 6) AS window_seconds",
)


def _auth(spark: SparkSession, sf: str, **more: int) -> DataFrame:
    found = chains.auth_chain(windows_events(spark, sf), fail_threshold=2, window_seconds=86400, **more)
    return rounded(micros(found, "ts"), "window_seconds").select(
        "source_id", "line_no", "ts", "computer", "matched_value", "fail_count", "fail_first_line",
        "fail_nth_line", "fail_last_line", "window_seconds",
    )


@query("detect_auth_chain", _AUTH_SQL)
def auth(spark: SparkSession, sf: str) -> DataFrame:
    return _auth(spark, sf)


@query("detect_auth_chain_large_groups", _AUTH_SQL)
def auth_large(spark: SparkSession, sf: str) -> DataFrame:
    """Every account over 20 rows takes the way of oversized groups."""
    return _auth(spark, sf, group_rows=20, chunk=2048)


# ---- step sequences -------------------------------------------------------------------------------

_SEQ_SQL = f"""{WEB_CTE},
m AS (SELECT source_id, f_src_ip AS k, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, line_no,
        lower(f_status) = '401' AS s0, lower(f_status) = '200' AS s1
      FROM w WHERE ts IS NOT NULL AND f_src_ip NOT IN ('', '-')),
a AS (SELECT source_id, k, count(*) AS n,
        max(sec) AS sec FROM m WHERE s0 GROUP BY source_id, k HAVING count(*) >= 3),
b AS (SELECT a.source_id, a.k, a.n, a.sec, max(m.line_no) AS line_no FROM a JOIN m
      ON m.source_id = a.source_id AND m.k = a.k AND m.sec = a.sec AND m.s0 GROUP BY ALL),
c AS (SELECT b.*, min({{'s': m.sec, 'l': m.line_no}}) AS nxt FROM b JOIN m ON m.source_id = b.source_id AND m.k = b.k AND m.s1
      AND (m.sec > b.sec OR (m.sec = b.sec AND m.line_no > b.line_no)) AND m.sec - b.sec <= 86400 GROUP BY ALL),
u AS (SELECT source_id, count(*) AS no_ts FROM w WHERE ts IS NULL GROUP BY source_id)
SELECT c.source_id, c.nxt.l AS line_no, c.k AS matched_value, c.n AS first_step_count, c.sec AS first_step_last_sec,
  c.nxt.s AS final_sec, CAST(c.line_no AS VARCHAR) || ',' || CAST(c.nxt.l AS VARCHAR) AS chain_lines,
  coalesce(u.no_ts, 0) AS events_without_ts
FROM c LEFT JOIN u ON u.source_id = c.source_id"""


@query("detect_sequence_chain", _SEQ_SQL)
def sequence(spark: SparkSession, sf: str) -> DataFrame:
    found = chains.sequence_chain(
        web_events(spark, sf), steps=[("status", ["401"]), ("status", ["200"])], window_seconds=86400,
        key_fields=["src_ip"], min_first_step_count=3,
    )
    return found.select(
        "source_id", "line_no", "matched_value", "first_step_count", "first_step_last_sec", "final_sec",
        F.array_join("chain_lines", ",").alias("chain_lines"), "events_without_ts",
    )


# ---- statistics -----------------------------------------------------------------------------------

_BEACON_SQL = f"""{WEB_CTE},
k AS (SELECT source_id, f_src_ip AS ip, line_no, epoch_us(ts) AS t,
   epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source_id, f_src_ip ORDER BY line_no) AS d
   FROM w WHERE f_src_ip <> '' AND ts IS NOT NULL),
s AS (SELECT source_id, ip, count(*) AS samples, count(CASE WHEN d > 0 THEN 1 END) AS intervals,
   avg(CASE WHEN d > 0 THEN d / 1e6 END) AS mean, stddev_pop(CASE WHEN d > 0 THEN d / 1e6 END) AS sd,
   (arg_max(t, line_no) - arg_min(t, line_no)) / 1e6 AS span, max(line_no) AS line_no, arg_max(t, line_no) AS ts
   FROM k GROUP BY source_id, ip),
n AS (SELECT source_id, f_src_ip AS ip, count(*) AS c FROM w WHERE ts IS NULL GROUP BY ALL)
SELECT s.source_id, s.line_no, s.ts, s.ip AS matched_value, samples, intervals, round(span, 6) AS span_seconds,
  round(mean, 6) AS mean_interval_s, round(sd, 6) AS stddev_interval_s, round(sd / mean, 6) AS cv,
  coalesce(n.c, 0) AS events_without_ts, 'weak' AS evidence_grade
FROM s LEFT JOIN n ON n.source_id = s.source_id AND n.ip = s.ip
WHERE samples >= 12 AND intervals >= 2 AND span >= 3600 AND sd / mean <= 0.9"""


@query("detect_beacon_periodicity", _BEACON_SQL)
def beacon(spark: SparkSession, sf: str) -> DataFrame:
    found = web.beacon_periodicity(web_events(spark, sf), max_cv=0.9)
    return rounded(micros(found, "ts"), "span_seconds", "mean_interval_s", "stddev_interval_s", "cv").select(
        "source_id", "line_no", "ts", "matched_value", "samples", "intervals", "span_seconds", "mean_interval_s",
        "stddev_interval_s", "cv", "events_without_ts", "evidence_grade",
    )


_SPIKE_SQL = f"""{WEB_CTE},
b AS (SELECT source_id, f_src_ip AS ip, CAST(floor(epoch_us(ts) / 1000000 / 86400) AS BIGINT) AS bucket, count(*) AS c,
   min(line_no) AS line_no, arg_min(epoch_us(ts), line_no) AS ts FROM w WHERE f_src_ip <> '' AND ts IS NOT NULL GROUP BY ALL),
s AS (SELECT source_id, ip, count(*) AS buckets, avg(c) AS mean, stddev_pop(c) AS sd FROM b GROUP BY ALL),
z AS (SELECT b.*, s.buckets, s.mean, s.sd, (b.c - s.mean) / nullif(s.sd, 0) AS z,
   row_number() OVER (PARTITION BY b.source_id, b.ip ORDER BY b.c DESC, b.bucket) AS rn
   FROM b JOIN s ON s.source_id = b.source_id AND s.ip = b.ip),
n AS (SELECT source_id, f_src_ip AS ip, count(*) AS c FROM w WHERE ts IS NULL GROUP BY ALL)
SELECT z.source_id, z.line_no, z.ts, z.ip AS matched_value, z.c AS bucket_count, z.buckets, round(z.mean, 6) AS mean_per_bucket,
  round(z.sd, 6) AS stddev_per_bucket, round(z.z, 6) AS z, coalesce(n.c, 0) AS events_without_ts
FROM z LEFT JOIN n ON n.source_id = z.source_id AND n.ip = z.ip
WHERE rn = 1 AND z.buckets >= 5 AND z.c >= 3 AND z.z > 1.5"""


@query("detect_ip_rate_spike", _SPIKE_SQL)
def spike(spark: SparkSession, sf: str) -> DataFrame:
    found = web.ip_rate_spike(
        web_events(spark, sf), bucket_seconds=86400, min_buckets=5, z_threshold=1.5, min_bucket_count=3
    )
    return rounded(micros(found, "ts"), "mean_per_bucket", "stddev_per_bucket", "z").select(
        "source_id", "line_no", "ts", "matched_value", "bucket_count", "buckets", "mean_per_bucket",
        "stddev_per_bucket", "z", "events_without_ts",
    )


_DIV_BUCKETS = f"""{WEB_CTE},
b AS (SELECT source_id, f_path, f_src_ip, f_method AS bucket, count(*) AS events, avg(try_cast(f_bytes AS DOUBLE)) AS mean,
   min(line_no) AS first_line FROM w
   WHERE f_path NOT IN ('', '-') AND f_src_ip NOT IN ('', '-') AND f_method NOT IN ('', '-') GROUP BY ALL),
s AS (SELECT source_id, f_path, f_src_ip, CAST(sum(events) AS BIGINT) AS total_events, count(mean) AS buckets,
   min(mean) AS lo, max(mean) AS hi, min(first_line) AS line_no FROM b GROUP BY ALL),
h AS (SELECT *, 'path=' || f_path || ' src_ip=' || f_src_ip AS key FROM s WHERE total_events >= 3 AND buckets >= 2
   AND ((lo <= 0 AND hi > 0) OR (lo > 0 AND hi / lo >= 4)))"""


def _div(spark: SparkSession, sf: str) -> dict[str, object]:
    return {"key_fields": ["path", "src_ip"], "diverge_field": "method", "min_group_events": 3, "diverge_ratio": 4.0}


@query(
    "detect_key_divergence_mean_ratio",
    f"""{_DIV_BUCKETS}
SELECT source_id, line_no, key, total_events, buckets, round(lo, 6) AS lowest_mean, round(hi, 6) AS highest_mean,
  round(CASE WHEN lo > 0 THEN hi / lo END, 6) AS ratio FROM h""",
)
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    found = web.key_divergence(web_events(spark, sf), None, **_div(spark, sf))
    return rounded(found, "lowest_mean", "highest_mean", "ratio").select(
        "source_id", "line_no", "key", "total_events", "buckets", "lowest_mean", "highest_mean", "ratio"
    )


@query(
    "detect_key_divergence_buckets",
    f"""{_DIV_BUCKETS}
SELECT b.source_id, h.key, b.bucket, b.events, round(b.mean, 6) AS mean FROM b JOIN h
  ON h.source_id = b.source_id AND h.f_path = b.f_path AND h.f_src_ip = b.f_src_ip WHERE b.mean IS NOT NULL""",
)
def divergence_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = web.divergence_bucket_rows(web_events(spark, sf), None, **_div(spark, sf))  # type: ignore[arg-type]
    return rounded(found, "mean").select("source_id", "key", "bucket", "events", "mean")


@query(
    "detect_key_divergence_distinct",
    f"""{WEB_CTE},
p AS (SELECT source_id, f_src_ip, f_ua, count(*) AS c, max(line_no) AS l FROM w
  WHERE f_src_ip NOT IN ('', '-') AND f_ua NOT IN ('', '-') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, f_src_ip ORDER BY f_ua COLLATE C) AS rn FROM p)
SELECT source_id, max(l) AS line_no, f_src_ip AS matched_value, count(*) AS distinct_values, CAST(sum(c) AS BIGINT) AS total_events,
  string_agg(CASE WHEN rn <= 10 THEN f_ua END, '|' ORDER BY rn) AS value_samples
FROM r GROUP BY source_id, f_src_ip HAVING count(*) >= 12""".replace(" COLLATE C", ""),
)
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    found = web.key_divergence(web_events(spark, sf), None, min_distinct=12)
    return found.select(
        "source_id", "line_no", "matched_value", "distinct_values", "total_events",
        F.array_join("value_samples", "|").alias("value_samples"),
    )


@query(
    "detect_key_divergence_values",
    f"""{WEB_CTE},
p AS (SELECT source_id, f_src_ip, f_ua, count(*) AS c FROM w WHERE f_src_ip NOT IN ('', '-') AND f_ua NOT IN ('', '-') GROUP BY ALL),
k AS (SELECT source_id, f_src_ip FROM p GROUP BY ALL HAVING count(*) >= 12)
SELECT source_id, f_src_ip AS key, f_ua AS value, c AS events FROM p SEMI JOIN k USING (source_id, f_src_ip)""",
)
def divergence_values(spark: SparkSession, sf: str) -> DataFrame:
    return web.divergence_values(web_events(spark, sf), min_distinct=12).select("source_id", "key", "value", "events")


@query(
    "detect_cross_key_same_value",
    f"""{WEB_CTE},
t AS (SELECT * FROM w WHERE f_ua NOT IN ('', '-') AND f_src_ip <> ''
  AND NOT regexp_matches(f_ua, '(?i)^mozilla/4\\.') AND NOT regexp_matches(f_ua, '(?i)^mozilla/5\\.0.*(chrome|safari|firefox|edge)')
  AND NOT (contains(lower(f_ua), 'curl/') OR contains(lower(f_ua), 'bot/') OR contains(lower(f_ua), 'java/'))),
s AS (SELECT f_ua, count(DISTINCT f_src_ip) AS key_count, count(*) AS df,
  min({{'s': source_id, 'l': line_no}}) AS f, string_agg(DISTINCT f_src_ip, '|' ORDER BY f_src_ip) AS keys FROM t GROUP BY f_ua)
SELECT f.s AS source_id, f.l AS line_no, f_ua AS matched_value, key_count, df, keys,
  CASE WHEN key_count >= 2 THEN 'strong' END AS evidence_grade FROM s WHERE key_count >= 2 AND df <= 5""",
)
def same_value(spark: SparkSession, sf: str) -> DataFrame:
    found = web.cross_key_same_value(web_events(spark, sf), min_keys=2)
    return found.select(
        "source_id", "line_no", "matched_value", "key_count", "df", F.array_join("keys", "|").alias("keys"),
        "evidence_grade",
    )


@query(
    "detect_size_outlier",
    f"""{WEB_CTE},
t AS (SELECT source_id, f_path, f_method, f_status, line_no, try_cast(f_bytes AS DOUBLE) AS v FROM w
  WHERE f_path NOT IN ('', '-') AND f_method NOT IN ('', '-') AND f_status NOT IN ('', '-') AND try_cast(f_bytes AS DOUBLE) IS NOT NULL),
m AS (SELECT source_id, f_path, f_method, f_status, count(*) AS n, median(v) AS med FROM t GROUP BY ALL HAVING count(*) >= 20 AND median(v) > 0),
o AS (SELECT t.*, m.n, m.med, row_number() OVER (PARTITION BY t.source_id, t.f_path, t.f_method, t.f_status
    ORDER BY abs(v - med) DESC, line_no) AS rn FROM t JOIN m USING (source_id, f_path, f_method, f_status) WHERE v > med * 3 OR v < med / 3)
SELECT source_id, max(CASE WHEN rn = 1 THEN line_no END) AS line_no,
  'path=' || f_path || ' method=' || f_method || ' status=' || f_status AS matched_value,
  max(n) AS samples, round(max(med), 6) AS median_bytes, count(*) AS outlier_count,
  string_agg(CASE WHEN rn <= 3 THEN CAST(line_no AS VARCHAR) || ':' || CASE WHEN v < med THEN 'smaller' ELSE 'larger' END END, '|' ORDER BY rn) AS outliers
FROM o GROUP BY source_id, f_path, f_method, f_status""",
)
def outlier(spark: SparkSession, sf: str) -> DataFrame:
    found = web.size_outlier(web_events(spark, sf), key_fields=["path", "method", "status"], min_samples=20)
    return rounded(found, "median_bytes").select(
        "source_id", "line_no", "matched_value", "samples", "median_bytes", "outlier_count",
        F.array_join(
            F.transform("outliers", lambda o: F.concat_ws(":", o["line_no"].cast("string"), o["direction"])), "|"
        ).alias("outliers"),
    )


@query(
    "detect_size_outlier_rows",
    f"""{WEB_CTE},
t AS (SELECT source_id, f_path, f_method, f_status, line_no, try_cast(f_bytes AS DOUBLE) AS v FROM w
  WHERE f_path NOT IN ('', '-') AND f_method NOT IN ('', '-') AND f_status NOT IN ('', '-') AND try_cast(f_bytes AS DOUBLE) IS NOT NULL),
m AS (SELECT source_id, f_path, f_method, f_status, median(v) AS med FROM t GROUP BY ALL HAVING count(*) >= 20 AND median(v) > 0)
SELECT source_id, line_no, 'path=' || f_path || ' method=' || f_method || ' status=' || f_status AS key, v AS bytes
FROM t JOIN m USING (source_id, f_path, f_method, f_status) WHERE v > med * 3 OR v < med / 3""",
)
def outlier_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = web.size_outlier_rows(web_events(spark, sf), key_fields=["path", "method", "status"], min_samples=20)
    return found.select("source_id", "line_no", "key", "bytes")


# ---- host -----------------------------------------------------------------------------------------

_ANCHOR = "source_id, line_no, epoch_us(ts) AS ts"


@query(
    "detect_persistence_task",
    f"""{WIN_CTE},
t AS (SELECT *, trim(regexp_extract(d_TaskContent, '<Command>([^<]+)</Command>', 1)) AS cmd,
   trim(regexp_extract(d_TaskContent, '<Arguments>([^<]*)</Arguments>', 1)) AS args FROM w WHERE f_event_id IN ('4698', '4702')),
x AS (SELECT *, lower(cmd || ' ' || args) AS e FROM t WHERE cmd <> '' AND regexp_matches(lower(d_TaskName), 'microsoft|windows|google|adobe|intel|nvidia'))
SELECT {_ANCHOR}, d_TaskName AS matched_value, CAST(f_event_id AS BIGINT) AS event_id, cmd AS command, args AS arguments,
  d_SubjectUserName AS subject_user, 'suspect' AS evidence_grade
FROM x WHERE contains(e, '\\temp\\') OR contains(e, '\\tmp\\') OR contains(e, '\\users\\public\\') OR contains(e, 'powershell')""",
)
def task(spark: SparkSession, sf: str) -> DataFrame:
    found = host.persistence_task(windows_events(spark, sf))
    return micros(found, "ts").select(
        "source_id", "line_no", "ts", "matched_value", "event_id", "command", "arguments", "subject_user", "evidence_grade"
    )


@query(
    "detect_service_install",
    f"""{WIN_CTE}
SELECT {_ANCHOR}, d_ServiceName AS matched_value, d_ImagePath AS image_path,
  CASE WHEN contains(lower(d_ImagePath), '\\temp\\') OR contains(lower(d_ImagePath), '\\programdata\\')
    OR (contains(lower(d_ImagePath), 'powershell') AND contains(lower(d_ImagePath), '-enc')) THEN 'strong' ELSE 'suspect' END AS evidence_grade
FROM w WHERE f_event_id = '7045' AND (d_ImagePath <> '' OR d_ServiceName <> '')""",
)
def service(spark: SparkSession, sf: str) -> DataFrame:
    found = host.service_install(windows_events(spark, sf))
    return micros(found, "ts").select("source_id", "line_no", "ts", "matched_value", "image_path", "evidence_grade")


_TARGETS = "['svchost','lsass','csrss','explorer','rundll32','services','winlogon','taskhost','sihost','runtimebroker']"


@query(
    "detect_process_tree",
    f"""{WIN_CTE},
p AS (SELECT *, coalesce(nullif(d_NewProcessName, ''), d_ProcessName) AS path FROM w WHERE f_event_id = '4688'),
q AS (SELECT *, lower(replace(trim(trim(path), '"'''), '/', '\\')) AS norm FROM p WHERE contains(path, '\\')),
n AS (SELECT *, regexp_extract(norm, '([^\\\\]*)$', 1) AS base FROM q),
c AS (SELECT n.*, CASE WHEN ends_with(base, '.exe') THEN left(base, length(base) - 4) ELSE base END AS nm FROM n),
d AS (SELECT c.*, list_filter({_TARGETS}, lambda t: t = nm OR levenshtein(t, nm) = 1)[1] AS target,
   starts_with(norm, 'c:\\windows\\system32\\') AS sysdir FROM c)
SELECT {_ANCHOR}, base AS matched_value, path AS process_path, target AS lookalike_target,
  CASE WHEN target = nm THEN 'exact' ELSE 'edit1' END AS similarity, CAST(sysdir AS INTEGER) AS whitelisted_path,
  CASE WHEN target = nm THEN 'strong' ELSE 'suspect' END AS evidence_grade
FROM d WHERE target IS NOT NULL AND NOT (sysdir AND target = nm)""",
)
def process(spark: SparkSession, sf: str) -> DataFrame:
    found = host.process_tree(windows_events(spark, sf))
    return micros(found, "ts").select(
        "source_id", "line_no", "ts", "matched_value", "process_path", "lookalike_target", "similarity",
        F.col("whitelisted_path").cast("int").alias("whitelisted_path"), "evidence_grade",
    )


@query(
    "detect_credential_face",
    f"""{WIN_CTE}
SELECT {_ANCHOR}, 'explicit_credential' AS wing, d_TargetUserName AS matched_value, d_TargetServerName AS target_server,
  d_ProcessName AS process, 'suspect' AS evidence_grade
FROM w WHERE f_event_id = '4648' AND lower(d_TargetServerName) NOT IN ('', '-', 'localhost', '127.0.0.1', '::1')
UNION ALL
SELECT {_ANCHOR}, 'sam_access', d_ObjectName, '', d_ProcessName, 'strong'
FROM w WHERE f_event_id IN ('4656', '4663') AND regexp_matches(lower(d_ObjectName), '(registry\\\\machine|hklm)\\\\(sam|security)')
  AND NOT ends_with(lower(d_ProcessName), '\\lsass.exe')""",
)
def credential(spark: SparkSession, sf: str) -> DataFrame:
    found = host.credential_face(windows_events(spark, sf))
    return micros(found, "ts").select(
        "source_id", "line_no", "ts", "wing", "matched_value", "target_server", "process", "evidence_grade"
    )


_BURST_CTE = f"""{USN_CTE},
c AS (SELECT source_id, line_no, epoch_us(ts) AS t,
    CASE WHEN contains(f_path, '.') THEN lower(regexp_extract(f_path, '\\.([^.]*)$', 1)) ELSE '(none)' END AS ext
  FROM ev WHERE f_reason_hex IN ('0x00000100', '0x80000200', '0x00002000', '0x00000003')),
x AS (SELECT * FROM c WHERE ext <> 'log'),
d AS (SELECT *, count(*) OVER z AS n, max(t) OVER z AS t_end FROM x WHERE t IS NOT NULL
  WINDOW z AS (PARTITION BY source_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 21600000000 FOLLOWING)),
b AS (SELECT source_id, max(n) AS n FROM d GROUP BY source_id HAVING max(n) >= 5),
f AS (SELECT d.source_id, d.n, min(d.t) AS t0, arg_min(d.t_end, d.t) AS t1 FROM d JOIN b ON b.source_id = d.source_id AND b.n = d.n GROUP BY d.source_id, d.n)"""


@query(
    "detect_time_cluster",
    f"""{_BURST_CTE}
SELECT f.source_id, min(CASE WHEN x.t = f.t0 THEN x.line_no END) AS line_no, f.t0 AS ts, f.n AS events_in_window,
  f.t0 AS window_start, f.t1 AS window_end, max(CASE WHEN x.t = f.t1 THEN x.line_no END) AS last_line,
  count(CASE WHEN x.t IS NULL THEN 1 END) AS events_without_ts
FROM f JOIN x ON x.source_id = f.source_id GROUP BY f.source_id, f.n, f.t0, f.t1""",
)
def burst(spark: SparkSession, sf: str) -> DataFrame:
    found = host.time_cluster(usn_events(spark, sf), window_seconds=21600, min_events=5)
    return micros(found, "ts", "window_start", "window_end").select(
        "source_id", "line_no", "ts", "events_in_window", "window_start", "window_end", "last_line", "events_without_ts"
    )


@query(
    "detect_time_cluster_extensions",
    f"""{_BURST_CTE}
SELECT f.source_id, x.ext, count(*) AS events FROM f JOIN x ON x.source_id = f.source_id AND x.t BETWEEN f.t0 AND f.t1
GROUP BY f.source_id, x.ext""",
)
def burst_extensions(spark: SparkSession, sf: str) -> DataFrame:
    found = host.time_cluster_extensions(usn_events(spark, sf), window_seconds=21600, min_events=5)
    return found.select("source_id", "ext", "events")


# ---- cross ----------------------------------------------------------------------------------------

_IP = (
    "CASE WHEN d_IpAddress NOT IN ('-', '') AND starts_with(d_IpAddress, '203.') THEN d_IpAddress "
    "WHEN starts_with(d_IpAddress, '2001:0DB8') THEN '2001:db8::' || ltrim(split_part(d_IpAddress, ':', 8), '0') "
    "WHEN d_SourceNetworkAddress <> '' THEN d_SourceNetworkAddress END"
)
_CROSS_CTE = f"""{WIN_CTE},
i AS (SELECT source_id, host, line_no, epoch_us(ts) AS t, CASE WHEN ip = '2001:db8::' THEN '2001:db8::' ELSE ip END AS ip
  FROM (SELECT *, {_IP} AS ip FROM w) WHERE ip IS NOT NULL)"""


@query(
    "detect_cross_entity_multi_source",
    f"""{_CROSS_CTE},
s AS (SELECT ip, source_id, count(*) AS c, min(line_no) AS l, arg_min(t, line_no) FILTER (WHERE TRUE) AS t0,
   min({{'l': line_no, 't': coalesce(t, -1)}}) AS f FROM i GROUP BY ip, source_id),
r AS (SELECT *, nullif(f.t, -1) AS ft, row_number() OVER (PARTITION BY ip ORDER BY nullif(f.t, -1) NULLS LAST, l, source_id) AS rn FROM s)
SELECT ip AS matched_value, max(CASE WHEN rn = 1 THEN source_id END) AS source_id, max(CASE WHEN rn = 1 THEN l END) AS line_no,
  max(CASE WHEN rn = 1 THEN ft END) AS ts, count(*) AS source_count, CAST(sum(c) AS BIGINT) AS total_events
FROM r GROUP BY ip HAVING count(*) >= 2""",
)
def multi_source(spark: SparkSession, sf: str) -> DataFrame:
    found = cross.cross_entity_multi_source(windows_events(spark, sf))
    return micros(found, "ts").select(
        "matched_value", "source_id", "line_no", "ts", "source_count", "total_events"
    )


@query(
    "detect_cross_entity_sources",
    f"""{_CROSS_CTE}
SELECT ip AS entity, source_id, count(*) AS events, min(line_no) AS first_line FROM i GROUP BY ip, source_id""",
)
def entity_sources(spark: SparkSession, sf: str) -> DataFrame:
    return cross.entity_sources(windows_events(spark, sf)).drop("case_id")


def _cross_host_sql(entities: str) -> str:
    return f"""{entities},
h AS (SELECT e, host, source_id, count(*) AS c, min({{'l': line_no, 't': coalesce(t, -1)}}) AS f FROM i2 WHERE host <> '' GROUP BY ALL),
r AS (SELECT *, nullif(f.t, -1) AS ft, row_number() OVER (PARTITION BY e ORDER BY nullif(f.t, -1) NULLS LAST, f.l, source_id) AS rn FROM h)
SELECT e AS matched_value, max(CASE WHEN rn = 1 THEN source_id END) AS source_id, max(CASE WHEN rn = 1 THEN f.l END) AS line_no,
  max(CASE WHEN rn = 1 THEN ft END) AS ts, count(DISTINCT host) AS host_count, count(*) AS source_count,
  CAST(sum(c) AS BIGINT) AS total_events
FROM r GROUP BY e HAVING count(DISTINCT host) >= 2"""


def _cross_host(spark: SparkSession, sf: str, entity_type: str) -> DataFrame:
    found = cross.cross_host_entity(windows_events(spark, sf), entity_type=entity_type)
    return micros(found, "ts").select(
        "matched_value", "source_id", "line_no", "ts", "host_count", "source_count", "total_events"
    )


@query("detect_cross_host_ip", _cross_host_sql(f"{_CROSS_CTE}, i2 AS (SELECT *, ip AS e FROM i)"))
def cross_ip(spark: SparkSession, sf: str) -> DataFrame:
    return _cross_host(spark, sf, "ip")


@query(
    "detect_cross_host_sid",
    _cross_host_sql(
        f"{WIN_CTE}, i2 AS (SELECT *, epoch_us(ts) AS t, upper(d_SubjectUserSid) AS e FROM w WHERE d_SubjectUserSid <> 'none')"
    ),
)
def cross_sid(spark: SparkSession, sf: str) -> DataFrame:
    return _cross_host(spark, sf, "account_sid")


@query(
    "detect_cross_host_file_hash",
    _cross_host_sql(f"{WIN_CTE}, i2 AS (SELECT *, epoch_us(ts) AS t, d_sha256 AS e FROM w WHERE d_sha256 <> 'unknown')"),
)
def cross_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _cross_host(spark, sf, "file_sha256")


@query(
    "domain_routing",
    f"""WITH {EV}, d AS (SELECT DISTINCT source_id, log_type FROM ev)
SELECT CAST(count(CASE WHEN log_type = 'web_access' THEN 1 END) AS BIGINT) AS matched_sources,
  CAST(count(CASE WHEN log_type <> 'web_access' THEN 1 END) AS BIGINT) AS skipped_domain FROM d""",
)
def routing(spark: SparkSession, sf: str) -> DataFrame:
    from quernlog.functions.fields import in_domain
    from quernlog.plans.adapters import source_table

    sources = source_table(web_events(spark, sf))
    return sources.agg(
        F.count_if(in_domain(["web_access"])).alias("matched_sources"),
        F.count_if(~in_domain(["web_access"])).alias("skipped_domain"),
    )
