"""Signature-rule scan, entity extraction and candidate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.data.rules import ALL_RULES, EVENT_RULES, WEB_RULES
from quernlog.operators import entities, rules
from quernlog.plans.adapters import WEB, WEB_RAW, WINDOWS, WINDOWS_RAW, duck_cte, table, web_events, windows_events
from quernlog.plans.registry import query


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(picked: list[dict], fields: dict[str, str]) -> str:
    """One SELECT per rule; rules over fields the table does not have cannot match."""
    parts = []
    for rule in picked:
        conds = rules.conditions(rule)
        if any(c.field not in fields for c in conds):
            continue
        tests, first = [], ""
        for field in dict.fromkeys(c.field for c in conds):
            text = f"lower({fields[field]})"
            alts = [
                (
                    {
                        "contains": f"contains({text}, {_quote(n)})", "eq": f"{text} = {_quote(n)}",
                        "prefix": f"starts_with({text}, {_quote(n)})", "endswith": f"ends_with({text}, {_quote(n)})",
                    }[c.op],
                    n,
                )
                for c in conds if c.field == field for n in c.needles
            ]
            tests.append("(" + " OR ".join(a for a, _ in alts) + ")")
            first = first or "CASE " + " ".join(f"WHEN {a} THEN {_quote(n)}" for a, n in alts) + " END"
        parts.append(
            f"SELECT source_id, line_no, {_quote(rule['id'])} AS rule_id, {_quote(rule['severity'])} AS severity, "
            f"{_quote(conds[0].field)} AS matched_field, {first} AS matched_value FROM w WHERE " + " AND ".join(tests)
        )
    return " UNION ALL ".join(parts)


_WEB_FIELDS = {"method": "f_method", "path": "f_path", "query": "f_query", "ua": "f_ua", "raw": "raw"}
_WEB_CTE = f"WITH {duck_cte(WEB)}, w AS (SELECT *, {WEB_RAW} AS raw FROM ev WHERE kind = 'event')"
_WEB_HITS = f"{_WEB_CTE}, hits AS ({_rule_sql(EVENT_RULES, _WEB_FIELDS)})"
_DATA = "CAST(json_object(" + ", ".join(f"'{k[2:]}', \"{k}\"" for k in WINDOWS if k.startswith("d_")) + ") AS VARCHAR)"
_WIN_FIELDS = {"channel": "f_channel", "event_id": "f_event_id", "data": "data"}
_WIN_CTE = f"WITH {duck_cte(WINDOWS)}, w AS (SELECT *, {WINDOWS_RAW} AS raw, {_DATA} AS data FROM ev)"
_SHOWN = ["source_id", "line_no", "rule_id", "severity", "matched_field", "matched_value"]


@query("rule_scan_web", f"{_WEB_HITS} SELECT * FROM hits")
def scan_web(spark: SparkSession, sf: str) -> DataFrame:
    return rules.event_rule_hits(web_events(spark, sf)).select(*_SHOWN)


#: Conditions on one field are alternatives, whichever of them the row meets; written out by hand.
_SAME_FIELD = [
    {"id": "same-1", "severity": "low", "title": "", "target": "event", "min_hosts": 0, "max_hits": 500,
     "match": {"path_prefix": ["/admin", "/wp-"], "path_endswith": [".php"], "status_eq": ["200", "404"]}},
    {"id": "same-2", "severity": "low", "title": "", "target": "event", "min_hosts": 0, "max_hits": 500,
     "match": {"ua_eq": ["none at all"], "ua_contains": ["tool1", "sqlmap"]}},
]


@query(
    "rule_scan_same_field",
    f"""WITH {duck_cte(WEB)}, w AS (SELECT *, lower(f_path) AS p, lower(f_ua) AS u FROM ev WHERE kind = 'event')
SELECT source_id, line_no, 'same-1' AS rule_id, 'low' AS severity, 'path' AS matched_field,
  CASE WHEN p LIKE '/admin%' THEN '/admin' WHEN p LIKE '/wp-%' THEN '/wp-' ELSE '.php' END AS matched_value
FROM w WHERE (p LIKE '/admin%' OR p LIKE '/wp-%' OR p LIKE '%.php') AND f_status IN ('200', '404')
UNION ALL SELECT source_id, line_no, 'same-2', 'low', 'ua', CASE WHEN u LIKE '%tool1%' THEN 'tool1' ELSE 'sqlmap' END
FROM w WHERE u = 'none at all' OR u LIKE '%tool1%' OR u LIKE '%sqlmap%'""",
)
def scan_same_field(spark: SparkSession, sf: str) -> DataFrame:
    return rules.event_rule_hits(web_events(spark, sf), _SAME_FIELD).select(*_SHOWN)


@query("rule_scan_windows", f"{_WIN_CTE}, hits AS ({_rule_sql(EVENT_RULES, _WIN_FIELDS)}) SELECT * FROM hits")
def scan_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rules.event_rule_hits(windows_events(spark, sf, promoted=False)).select(*_SHOWN)


# command-line rules read the raw document text as commands
_DOC_RULES = [r for r in EVENT_RULES if list(r["match"]) == ["command_contains"]] + [
    {**WEB_RULES[2], "id": "text-the", "match": {"raw": ["the ", "and"]}},
]
_DOC_CTE = "WITH w AS (SELECT source AS source_id, doc_id AS line_no, text AS raw, text AS command FROM documents)"


@query("rule_scan_documents", f"{_DOC_CTE}, hits AS ({_rule_sql(_DOC_RULES, {'command': 'command', 'raw': 'raw'})}) SELECT * FROM hits")
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.lit("c1").alias("case_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("line_no"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit("event").alias("kind"), F.lit("{}").alias("fields"),
        F.col("text").alias("raw"), F.col("text").alias("f_command"),
    )
    return rules.event_rule_hits(docs, _DOC_RULES).select(*_SHOWN)


_OUTCOME = f"""{_WEB_HITS},
f AS (SELECT *, (line_no % 5 <> 0) AS is_new FROM hits),
r AS (SELECT *, sum(CAST(is_new AS INTEGER)) OVER (PARTITION BY rule_id ORDER BY source_id, line_no) AS seen FROM f),
o AS (SELECT *, CASE WHEN seen - CAST(is_new AS INTEGER) >= 40 THEN 'truncated' WHEN is_new THEN 'new' ELSE 'dup' END AS outcome FROM r)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    hits = rules.event_rule_hits(web_events(spark, sf))
    stored = hits.filter("line_no % 5 = 0").select(*rules.KEY)
    return rules.with_outcome(hits, stored, cap=40)


@query("rule_scan_budget", f"{_OUTCOME} SELECT source_id, line_no, rule_id, outcome FROM o")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select("source_id", "line_no", "rule_id", "outcome")


_ALL_IDS = " UNION ALL ".join(f"SELECT '{r['id']}' AS rule_id" for r in ALL_RULES)


@query(
    "rule_scan_summary",
    f"""{_OUTCOME}, ids AS ({_ALL_IDS}), n AS (SELECT count(*) AS scanned FROM w)
SELECT ids.rule_id, max(n.scanned) AS scanned, count(CASE WHEN outcome = 'new' THEN 1 END) AS hits_new,
 count(CASE WHEN outcome = 'dup' THEN 1 END) AS hits_dup, count(CASE WHEN outcome = 'truncated' THEN 1 END) AS truncated
FROM ids CROSS JOIN n LEFT JOIN o ON o.rule_id = ids.rule_id GROUP BY ids.rule_id""",
)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    scanned = web_events(spark, sf).filter("kind = 'event'")
    return rules.scan_summary(_outcomes(spark, sf), scanned, rules.rule_table(spark))


# ---- entities -------------------------------------------------------------------------------------

_V6 = "'2001:db8::' || ltrim(split_part(d_IpAddress, ':', 8), '0')"
_ENT = f"""WITH {duck_cte(WINDOWS)},
m AS (
  SELECT host, source_id, line_no, 'ip' AS entity_type, d_IpAddress AS raw_value,
    CASE WHEN starts_with(d_IpAddress, '203.') THEN 'ip:' || d_IpAddress
         WHEN starts_with(d_IpAddress, '2001') THEN 'ip:' || {_V6}
         ELSE 'ip:' || d_IpAddress || '@' || host END AS canonical_key,
    CASE WHEN starts_with(d_IpAddress, '192.') THEN 'host_scoped' ELSE 'global' END AS qualifier
  FROM ev WHERE d_IpAddress <> '-'
  UNION ALL SELECT host, source_id, line_no, 'ip', d_SourceNetworkAddress, 'ip:' || d_SourceNetworkAddress, 'global'
  FROM ev WHERE d_SourceNetworkAddress <> ''
  UNION ALL SELECT host, source_id, line_no, 'account', upper(d_SubjectUserSid), 'acct:sid:' || upper(d_SubjectUserSid), 'global'
  FROM ev WHERE d_SubjectUserSid <> 'none'
  UNION ALL SELECT host, source_id, line_no, 'account', v, 'acct:name:' || lower(v) || '@' || host, 'host_scoped'
  FROM (SELECT *, unnest([d_SubjectUserName, d_TargetUserName]) AS v FROM ev WHERE d_SubjectUserSid = 'none') WHERE v <> '-'
  UNION ALL SELECT host, source_id, line_no, 'file_hash', d_sha256, 'hash:sha256:' || d_sha256, 'global'
  FROM ev WHERE d_sha256 <> 'unknown'),
e AS (SELECT host, entity_type, canonical_key, qualifier, min({{'s': source_id, 'l': line_no, 'r': raw_value}}) AS f FROM m GROUP BY ALL)"""


@query(
    "entity_table",
    f"{_ENT} SELECT host, entity_type, f.r AS raw_value, canonical_key, qualifier, f.s AS source_id, f.l AS line_no FROM e",
)
def entity_table(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_table(windows_events(spark, sf)).drop("case_id")


@query(
    "entity_rules_cross_host",
    f"""{_ENT},
g AS (SELECT entity_type, canonical_key, count(DISTINCT host) AS hosts, min(f) AS f FROM e WHERE qualifier = 'global' AND host <> '' GROUP BY ALL)
SELECT CASE entity_type WHEN 'ip' THEN 'xhost-shared-public-ip' WHEN 'account' THEN 'xhost-shared-account-sid' ELSE 'xhost-shared-file-hash' END AS rule_id,
  f.s AS source_id, f.l AS line_no, canonical_key AS matched_value, left(f.r || ' (' || canonical_key || ')', 240) AS snippet
FROM g WHERE hosts >= 2""",
)
def cross_host(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.entity_rule_hits(entities.entity_table(windows_events(spark, sf)))
    return found.select("rule_id", "source_id", "line_no", "matched_value", "snippet")


_DOMAIN = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(
    "entity_rules_domain",
    f"""WITH d AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Files.' ELSE 'pool.' END || regexp_extract(url, '^https?://([^/?#:]+)', 1) AS raw FROM pages),
e AS (SELECT 'dom:' || lower(raw) AS canonical_key, min({{'l': page_id + 1, 'r': raw}}) AS f FROM d GROUP BY 1)
SELECT 'miner-pool-domain-entity' AS rule_id, f.l AS line_no, 'pool.' AS matched_value, 'raw_value' AS hit_field
FROM e WHERE contains(lower(f.r), 'pool.')""".replace("'raw_value' AS hit_field", "'entity_type' AS matched_field").replace(
        "'pool.' AS matched_value", "'domain' AS matched_value"
    ),
)
def domains(spark: SparkSession, sf: str) -> DataFrame:
    site = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    name = F.concat(F.when(F.col("page_id") % 4 == 0, "Files.").otherwise("pool."), site)
    events = table(spark, sf, "pages").select(
        F.lit("c1").alias("case_id"), F.lit("s1").alias("source_id"), (F.col("page_id") + 1).alias("line_no"),
        F.lit("event").alias("kind"), F.lit("").alias("host"), F.to_json(F.struct(name.alias("domain"))).alias("fields"),
    )
    found = rules.entity_rule_hits(entities.entity_table(events))
    return found.select("rule_id", "line_no", "matched_value", "matched_field")
