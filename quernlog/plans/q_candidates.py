"""The whole scan of a case, and single functions checked on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.data.rules import ALL_RULES
from quernlog.functions.net import canonical_ip, ip_class
from quernlog.functions.paths import base_name, extension, normalize_path
from quernlog.operators import dedup, entities, review, rules
from quernlog.plans.adapters import WINDOWS, duck_cte, source_table, table, web_events, windows_events
from quernlog.plans.pipeline import DOMAINS, scan_case
from quernlog.plans.registry import query
from quernlog.plans.q_detect import WIN_CTE
from quernlog.plans.q_review import DEDUP_SQL

_RULE_IDS = " UNION ALL ".join(f"SELECT '{r['id']}' AS rule_id, '{r['title'].replace(chr(39), chr(39) * 2)}' AS title" for r in ALL_RULES)


def _service_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of one operator, as they come out of the scan of a case."""
    return scan_case(windows_events(spark, sf), only=("host-service-install",)).filter("rule_id = 'host-service-install'")


_SERVICES = f"""{WIN_CTE}, o AS (SELECT source_id, line_no, 'host-service-install' AS rule_id, 'high' AS severity FROM w WHERE f_event_id = '7045' AND (d_ImagePath <> '' OR d_ServiceName <> ''))"""


@query(
    "candidates_from_operator",
    f"{_SERVICES}, r AS (SELECT *, row_number() OVER (ORDER BY source_id, line_no) AS rn FROM o) SELECT source_id, line_no, rule_id, severity, CASE WHEN rn <= 1500 THEN 'new' ELSE 'truncated' END AS outcome FROM r",
)
def operator_hits(spark: SparkSession, sf: str) -> DataFrame:
    return rules.with_outcome(_service_hits(spark, sf), None, 1500).select("source_id", "line_no", "rule_id", "severity", "outcome")


@query("candidates_of_case")
def case_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = scan_case(web_events(spark, sf), families=("web", "cross")).unionByName(
        scan_case(windows_events(spark, sf), families=("host", "cross"))
    )
    return hits.groupBy("rule_id", "severity", "evidence_grade").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    "candidates_operator_summary",
    f"""{_SERVICES}, n AS (SELECT count(*) AS c FROM o), d AS (SELECT count(DISTINCT source_id) AS m FROM w)
SELECT 'host-service-install' AS op_id, d.m AS matched_sources, CAST(0 AS BIGINT) AS skipped_domain, n.c AS findings, n.c AS hits_new, CAST(0 AS BIGINT) AS hits_dup, CAST(0 AS BIGINT) AS truncated FROM n, d""",
)
def operator_totals(spark: SparkSession, sf: str) -> DataFrame:
    events = windows_events(spark, sf)
    outcomes = rules.with_outcome(_service_hits(spark, sf), None)
    return review.operator_summary(outcomes, source_table(events), {"host-service-install": DOMAINS["host-service-install"]})


@query(
    "candidates_rule_seeds",
    f"""WITH {duck_cte(WINDOWS)}, ids AS ({_RULE_IDS}), x AS (SELECT 'lateral-service-installed' AS rule_id, count(*) AS c FROM ev WHERE f_channel = 'System' AND f_event_id = '7045'
 UNION ALL SELECT 'lateral-remote-task-created', count(*) FROM ev WHERE f_channel = 'Security' AND f_event_id = '4698'
 UNION ALL SELECT 'lateral-service-writable-dir', count(*) FROM ev WHERE f_channel = 'System' AND f_event_id = '7045' AND (contains(lower(d_ImagePath), '\\temp\\') OR contains(lower(d_ImagePath), '\\programdata\\')
   OR (f_event_id = '7045' AND (contains(lower(d_TaskContent), '\\public\\') OR contains(lower(d_NewProcessName), '\\temp\\'))))
)
SELECT ids.rule_id, ids.title, x.c AS hits_new FROM x JOIN ids USING (rule_id) WHERE x.c > 0""",
)
def seeds(spark: SparkSession, sf: str) -> DataFrame:
    events = windows_events(spark, sf, promoted=False)
    outcomes = rules.with_outcome(rules.event_rule_hits(events), None)
    table_ = rules.rule_table(spark)
    return review.rule_seeds(rules.scan_summary(outcomes, events, table_), table_)


@query(
    "entities_new_since",
    f"""WITH {duck_cte(WINDOWS)}, e AS (SELECT DISTINCT host, 'hash:sha256:' || d_sha256 AS canonical_key, min(line_no) OVER (PARTITION BY host, d_sha256) AS first_line FROM ev WHERE d_sha256 <> 'unknown'),
old AS (SELECT DISTINCT host, 'hash:sha256:' || d_sha256 AS canonical_key FROM ev WHERE d_sha256 <> 'unknown' AND source_id = 's1')
SELECT host, canonical_key FROM (SELECT DISTINCT host, canonical_key FROM e) ANTI JOIN old USING (host, canonical_key)""",
)
def fresh_entities(spark: SparkSession, sf: str) -> DataFrame:
    events = windows_events(spark, sf)
    stored = entities.entity_table(events.filter("source_id = 's1'"))
    fresh = entities.new_entities(entities.entity_table(events), stored)
    return fresh.filter("entity_type = 'file_hash'").select("host", "canonical_key")


@query(
    "review_next_round",
    "SELECT 'c' || CAST(o_custkey % 7 AS VARCHAR) AS case_id, CAST(max(o_orderkey % 3) + 1 AS BIGINT) AS next_round FROM orders GROUP BY 1",
)
def rounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("'c' || CAST(o_custkey % 7 AS STRING) AS case_id", "o_orderkey % 3 AS round_no")
    return review.next_rounds(rows)


@query(
    "scalar_addresses",
    f"""WITH {duck_cte(WINDOWS)} SELECT source_id, line_no, CASE WHEN d_IpAddress = '-' THEN NULL WHEN starts_with(d_IpAddress, '2001') THEN '2001:db8::' || ltrim(split_part(d_IpAddress, ':', 8), '0') ELSE d_IpAddress END AS address,
 CASE WHEN d_IpAddress = '-' THEN NULL WHEN starts_with(d_IpAddress, '192.') THEN 'private' ELSE 'public' END AS class FROM ev""",
)
def addresses(spark: SparkSession, sf: str) -> DataFrame:
    canonical = canonical_ip(F.col("d_IpAddress"))
    return windows_events(spark, sf).select("source_id", "line_no", canonical.alias("address"), ip_class(canonical).alias("class"))


@query(
    "scalar_paths",
    f"""WITH {duck_cte(WINDOWS)}, p AS (SELECT source_id, line_no, lower(replace(trim(trim(d_NewProcessName), '"'), '/', '\\')) AS path FROM ev)
SELECT source_id, line_no, path, regexp_extract(path, '([^\\\\]*)$', 1) AS base, CASE WHEN contains(path, '.') THEN regexp_extract(path, '\\.([^.]*)$', 1) END AS ext FROM p""",
)
def paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows_events(spark, sf).withColumn("path", normalize_path(F.col("d_NewProcessName")))
    return rows.select("source_id", "line_no", "path", base_name(F.col("path")).alias("base"), extension(F.col("path")).alias("ext"))


@query(
    "dedup_threshold_sweep",
    DEDUP_SQL % "0.85, 0.7, 0.6, 0.5"
    + "SELECT threshold, count(*) AS total, count_if(verdict = 'exact')::BIGINT AS exact, count_if(verdict = 'similar')::BIGINT AS similar FROM v GROUP BY threshold",
)
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("id"), "text")
    return dedup.threshold_sweep(docs)
