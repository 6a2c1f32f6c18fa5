"""Candidate review, coverage, graph, report, audit, duplicate and file-record queries.

Orders stand for candidates, suppliers for sources, regions, nations and customers for the goal, intent and
fact nodes of an investigation, parts for a directory tree.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlog.functions.times import rfc3339_nano
from quernlog.operators import audit, dedup, files, graph, report, review
from quernlog.plans.adapters import duck_cte, table
from quernlog.plans.registry import query

HITS = {
    "case_id": "'c' || CAST(o_custkey % 7 AS STRING)", "hit_id": "o_orderkey", "source_id": "'s' || CAST(o_custkey % 120 AS STRING)",
    "line_no": "o_orderkey + 1", "rule_id": "'rule' || CAST(o_custkey % 37 AS STRING)",
    "severity": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' "
        "WHEN '4-NOT SPECIFIED' THEN 'info' ELSE 'other' END"
    ),
    "status": "CASE WHEN o_custkey % 37 = 5 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'rejected' END",
    "round_no": "CAST(o_orderkey % 3 AS INT)", "snippet": "'order ' || CAST(o_orderkey AS STRING)",
    "ts": "CASE WHEN o_orderkey % 19 = 3 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END",
    "created_at": "CAST(o_orderdate AS TIMESTAMP)",
}
SOURCES = {
    "case_id": "'c' || CAST(s_suppkey % 7 AS STRING)", "source_id": "'s' || CAST(s_suppkey AS STRING)",
    "host": "CASE WHEN s_nationkey = 0 THEN '' ELSE 'h' || CAST(s_nationkey AS STRING) END",
    "package": "'p' || CAST(s_suppkey % 3 AS STRING)",
    "path": "'d' || CAST(s_nationkey AS STRING) || '/e' || CAST(s_suppkey % 4 AS STRING) || '/' || s_name",
    "sha256": "'sha' || CAST(s_suppkey AS STRING)",
    "detect_status": "CASE s_suppkey % 9 WHEN 0 THEN 'pending_confirm' WHEN 1 THEN 'suspect' ELSE 'ok' END",
}
JOBS = {
    "source_id": "'s' || CAST(o_custkey % 90 AS STRING)", "started_at": "o_orderkey",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'failed' END",
    "parser": "CASE WHEN o_custkey % 4 = 0 THEN 'raw' ELSE 'access' END", "rows_total": "CAST(floor(o_totalprice) AS BIGINT)",
}
GOALS = {
    "id": "'g' || CAST(r_regionkey AS STRING)", "kind": "'goal'", "text": "r_name",
    "status": "CASE WHEN r_regionkey = 4 THEN 'closed' ELSE 'open' END", "created_by": "'human'", "parent_id": "CAST(NULL AS STRING)",
}
INTENTS = {
    "id": "'i' || CAST(n_nationkey AS STRING)", "kind": "'intent'", "text": "n_name",
    "status": (
        "CASE WHEN n_regionkey = 0 THEN 'supported' WHEN n_regionkey = 1 THEN 'denied' WHEN n_nationkey % 4 = 3 THEN 'parked' "
        "WHEN n_regionkey = 2 AND n_nationkey % 2 = 0 THEN 'open' WHEN n_nationkey % 3 = 0 THEN 'doubt' ELSE 'supported' END"
    ),
    "created_by": "CASE WHEN n_nationkey % 5 = 0 THEN 'human' ELSE 'ai' END", "parent_id": "'g' || CAST(n_regionkey AS STRING)",
}
FACTS = {
    "id": "'f' || CAST(c_custkey AS STRING)", "kind": "'fact'", "text": "c_name",
    "status": "CASE WHEN c_custkey % 5 = 0 THEN 'doubt' ELSE 'supported' END", "created_by": "'ai'",
    "parent_id": "CASE WHEN c_custkey % 50 = 7 THEN 'nowhere' ELSE 'i' || CAST(c_nationkey AS STRING) END",
}
ANCHORS = {
    "case_id": "'c1'", "node_id": "'f' || CAST(c_custkey AS STRING)",
    "source_id": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 's' || CAST(c_custkey % 130 AS STRING) END", "line_no": "c_custkey % 500",
    "hit_id": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3 END",
}
_EXTRA = {"case_id": "'c1'", "created_at": "CAST('2024-01-01 00:00:00' AS TIMESTAMP)"}


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), HITS)


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "supplier"), SOURCES)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_project(table(spark, sf, t), {**c, **_EXTRA}) for t, c in (("region", GOALS), ("nation", INTENTS), ("customer", FACTS))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "customer"), ANCHORS)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "'c1' AS case_id", "'f' || CAST(c_custkey AS STRING) AS from_id", "'i' || CAST(c_nationkey AS STRING) AS to_id",
        "CASE WHEN c_custkey % 3 = 0 THEN 'proves' ELSE 'yields' END AS kind",
    )


H = duck_cte(HITS, "h", "orders")
S = duck_cte(SOURCES, "s", "supplier")
_N = ", ".join(
    [duck_cte({**GOALS, **_EXTRA}, "goals", "region"), duck_cte({**INTENTS, **_EXTRA}, "intents", "nation"),
     duck_cte({**FACTS, **_EXTRA}, "facts", "customer")]
)
N = f"{_N}, n AS (SELECT * FROM goals UNION ALL BY NAME SELECT * FROM intents UNION ALL BY NAME SELECT * FROM facts)"
A = duck_cte(ANCHORS, "a", "customer")
# the chapter of a fact is the goal above its intent
CH = "ch AS (SELECT n.*, CASE WHEN n.kind = 'goal' THEN n.id WHEN n.kind = 'intent' THEN n.parent_id ELSE i.parent_id END AS chapter FROM n LEFT JOIN intents i ON n.kind = 'fact' AND i.id = n.parent_id)"


# ---- review ---------------------------------------------------------------------------------------

_SINCE = "1997-01-01 00:00:00"


@query(
    "review_rule_statistics",
    f"""WITH {H}, q AS (SELECT DISTINCT rule_id FROM h), w AS (SELECT * FROM h WHERE created_at >= TIMESTAMP '{_SINCE}'),
r AS (SELECT q.rule_id, count(w.hit_id) AS candidates, count(CASE WHEN status = 'accepted' THEN 1 END) AS accepted,
 count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN status = 'pending' THEN 1 END) AS pending
 FROM q LEFT JOIN w USING (rule_id) GROUP BY q.rule_id)
SELECT *, round(CASE WHEN accepted + rejected > 0 THEN accepted / (accepted + rejected) END, 6) AS acceptance_rate,
 CAST(accepted + rejected >= 10 AND accepted = 0 AS INTEGER) AS needs_review FROM r""",
)
def rule_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = hits(spark, sf)
    out = review.rule_statistics(rows, rows.select("rule_id").distinct(), _SINCE)
    return out.withColumns({"acceptance_rate": F.round("acceptance_rate", 6), "needs_review": F.col("needs_review").cast("int")})


_BATCH = """b AS (SELECT hit_id, arg_min(verdict, position) AS verdict FROM (SELECT l_orderkey * 2 AS hit_id,
 CASE l_linenumber % 2 WHEN 0 THEN 'accepted' ELSE 'rejected' END AS verdict, l_linenumber * 7 % 8 AS position FROM lineitem) GROUP BY 1)"""


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 2).alias("hit_id"), F.when(F.col("l_linenumber") % 2 == 0, "accepted").otherwise("rejected").alias("verdict"),
        F.lit("amy").alias("reviewer"), (F.col("l_linenumber") * 7 % 8).alias("position"),
    )


def _reviewed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = hits(spark, sf).withColumns(
        {"reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp")}
    )
    return review.apply_verdicts(rows, _batch(spark, sf))


@query(
    "review_verdict_results",
    f"WITH {H}, {_BATCH} SELECT b.hit_id, CASE WHEN h.status IS NULL THEN 'missing' WHEN h.status = 'pending' THEN 'ok' ELSE 'conflict' END AS result FROM b LEFT JOIN h USING (hit_id)",
)
def verdict_results(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf)[1]


@query(
    "review_verdicts_applied",
    f"WITH {H}, {_BATCH} SELECT h.hit_id, CASE WHEN b.hit_id IS NOT NULL AND h.status = 'pending' THEN b.verdict ELSE h.status END AS status, CASE WHEN b.hit_id IS NOT NULL AND h.status = 'pending' THEN 'amy' END AS reviewed_by FROM h LEFT JOIN b USING (hit_id)",
)
def verdicts_applied(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf)[0].select("hit_id", "status", "reviewed_by")


@query(
    "review_hit_page",
    f"WITH {H} SELECT hit_id, rule_id, source_id FROM h WHERE status = 'pending' AND round_no = 1 ORDER BY created_at, source_id, line_no, rule_id LIMIT 100 OFFSET 40",
)
def hit_page(spark: SparkSession, sf: str) -> DataFrame:
    return review.list_hits(hits(spark, sf), status="pending", round_no=1, limit=100, offset=40).select("hit_id", "rule_id", "source_id")


@query(
    "review_hits_after",
    f"""WITH {H} SELECT hit_id, rule_id, source_id FROM h WHERE status = 'pending' AND
 (created_at > TIMESTAMP '1995-06-17' OR (created_at = TIMESTAMP '1995-06-17' AND (source_id > 's3' OR (source_id = 's3' AND line_no > 100))))""",
)
def hits_after(spark: SparkSession, sf: str) -> DataFrame:
    after = (datetime(1995, 6, 17, tzinfo=UTC), "s3", 100, "~")
    return review.list_hits(hits(spark, sf), status="pending", limit=None, after=after).select("hit_id", "rule_id", "source_id")


@query(
    "review_severity_order",
    f"WITH {H} SELECT hit_id, severity FROM h WHERE status = 'accepted' ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 4 END, created_at, hit_id",
)
def severity_order(spark: SparkSession, sf: str) -> DataFrame:
    return report.findings(hits(spark, sf), sources(spark, sf)).select("hit_id", "severity")


@query("report_verdict_counts", f"WITH {H} SELECT case_id, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected FROM h GROUP BY 1")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.verdict_counts(hits(spark, sf))


# ---- sources, coverage, dashboards ----------------------------------------------------------------

_J = duck_cte(JOBS, "j", "orders")
_STATE = f"""WITH {S}, {_J}, l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC) AS rn FROM j),
x AS (SELECT s.*, l.status AS job_status, l.parser, l.rows_total FROM s LEFT JOIN l ON l.source_id = s.source_id AND rn = 1)"""


@query(
    "source_states",
    f"""{_STATE} SELECT source_id, rows_total, CASE WHEN detect_status = 'pending_confirm' THEN 'awaiting confirmation'
 WHEN detect_status = 'suspect' THEN 'suspect' WHEN job_status IS NULL THEN 'not ingested' WHEN job_status = 'failed' THEN 'failed'
 WHEN job_status = 'running' THEN 'running' WHEN parser = 'raw' THEN 'registered' ELSE 'parsed' END AS state FROM x""",
)
def source_states(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _project(table(spark, sf, "orders"), JOBS)
    return review.source_status(review.with_latest_job(sources(spark, sf), jobs)).select("source_id", "rows_total", "state")


_COV = f"""{H}, {S}, {N}, {A}, p AS (SELECT DISTINCT source_id, node_id FROM a),
t AS (SELECT source_id, count(*) AS intents, count(CASE WHEN n.kind = 'fact' THEN 1 END) AS facts FROM p LEFT JOIN n ON n.id = p.node_id GROUP BY 1),
g AS (SELECT source_id, count(*) AS hits FROM h GROUP BY 1),
c AS (SELECT s.host, s.package, s.source_id, coalesce(t.intents, 0) AS intents, coalesce(t.facts, 0) AS facts, coalesce(g.hits, 0) AS hits,
 CAST(t.intents IS NOT NULL AS INTEGER) AS explored FROM s LEFT JOIN t USING (source_id) LEFT JOIN g USING (source_id))"""


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return review.coverage(sources(spark, sf), anchors(spark, sf), nodes(spark, sf), hits(spark, sf))


@query("coverage_per_source", f"WITH {_COV} SELECT source_id, intents, facts, hits, explored FROM c")
def coverage_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf).select("source_id", "intents", "facts", "hits", F.col("explored").cast("int").alias("explored"))


@query(
    "coverage_rollup",
    f"WITH {_COV} SELECT host, package, count(*) AS sources_total, CAST(sum(explored) AS BIGINT) AS explored FROM c GROUP BY ROLLUP (host, package) HAVING NOT (host IS NULL)",
)
def coverage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return review.coverage_rollup(_coverage(spark, sf))


@query(
    "content_tree",
    f"""WITH {S}, d AS (SELECT case_id, split_part(path, '/', 1) AS dir, CAST(1 AS INTEGER) AS depth FROM s
 UNION ALL SELECT case_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM s)
SELECT case_id, dir, depth, count(*) AS sources FROM d GROUP BY ALL""",
)
def tree(spark: SparkSession, sf: str) -> DataFrame:
    return review.content_tree(sources(spark, sf))


_CASES = {"case_id": "'c' || CAST(n_nationkey AS STRING)", "archived_at": "CASE WHEN n_nationkey % 3 = 1 THEN 'x' END"}
_OV = f"""WITH {H}, {S}, {duck_cte(_CASES, 'k', 'nation')},
x AS (SELECT k.case_id, (SELECT count(*) FROM s WHERE s.case_id = k.case_id) AS sources, (SELECT count(*) FROM h WHERE h.case_id = k.case_id) AS candidates,
 (SELECT count(*) FROM h WHERE h.case_id = k.case_id AND status = 'pending') AS pending FROM k WHERE archived_at IS NULL),
y AS (SELECT *, CASE WHEN pending > 0 THEN 'pending' WHEN candidates > 0 THEN 'reviewed' WHEN sources > 0 THEN 'ingested' ELSE 'empty' END AS bucket FROM x)"""


@query("overview_cases", f"{_OV} SELECT * FROM y")
def case_rows(spark: SparkSession, sf: str) -> DataFrame:
    return review.case_counts(_project(table(spark, sf, "nation"), _CASES), sources(spark, sf), hits(spark, sf))


@query(
    "overview_totals",
    f"""{_OV} SELECT count(*) AS cases, CAST(sum(sources) AS BIGINT) AS sources, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(pending) AS BIGINT) AS pending,
 count(CASE WHEN bucket = 'pending' THEN 1 END) AS cases_pending, count(CASE WHEN bucket = 'reviewed' THEN 1 END) AS cases_reviewed,
 count(CASE WHEN bucket = 'ingested' THEN 1 END) AS cases_ingested, count(CASE WHEN bucket = 'empty' THEN 1 END) AS cases_empty,
 (SELECT count(*) FROM k WHERE archived_at IS NOT NULL) AS archived_cases FROM y""",
)
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return review.overview(_project(table(spark, sf, "nation"), _CASES), sources(spark, sf), hits(spark, sf))


@query(
    "overview_activity",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS entries FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY GROUP BY 1",
)
def activity(spark: SparkSession, sf: str) -> DataFrame:
    return review.daily_activity(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-30 12:00:00")


# ---- graph ----------------------------------------------------------------------------------------


@query("graph_chapters", f"WITH {N}, {CH} SELECT id, kind, chapter FROM ch")
def chapter_rows(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_chapter(nodes(spark, sf)).select("id", "kind", "chapter")


_UNF = "status IN ('open', 'awaiting_approval', 'running')"


@query(
    "graph_goal_verdicts",
    f"""WITH {N}, {CH}, c AS (SELECT chapter, count(*) AS intents, count(CASE WHEN {_UNF} THEN 1 END) AS unfinished,
 count(CASE WHEN status = 'supported' THEN 1 END) AS supported FROM ch WHERE kind = 'intent' AND status <> 'parked' GROUP BY 1)
SELECT g.id, coalesce(intents, 0) AS intents, coalesce(unfinished, 0) AS unfinished, coalesce(supported, 0) AS supported,
 CASE WHEN g.status <> 'open' OR coalesce(intents, 0) = 0 THEN g.status WHEN unfinished > 0 THEN 'open' WHEN supported = intents THEN 'closed_goal_met'
 WHEN supported = 0 THEN 'closed_goal_unmet' ELSE 'closed_goal_partial' END AS verdict FROM goals g LEFT JOIN c ON c.chapter = g.id""",
)
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.goal_verdicts(nodes(spark, sf)).select("id", "intents", "unfinished", "supported", "verdict")


_AUTO = "kind = 'intent' AND created_by <> 'human' AND status <> 'parked'"


@query(
    "graph_budget_gates",
    f"""WITH {N}, {CH}, p AS (SELECT chapter, count(*) AS c FROM ch WHERE {_AUTO} GROUP BY 1), t AS (SELECT count(*) AS c FROM n WHERE {_AUTO})
SELECT i.id, coalesce(p.c, 0) AS in_chapter, t.c AS in_case, CASE WHEN coalesce(p.c, 0) >= 3 THEN 'chapter' WHEN t.c >= 12 THEN 'case' END AS reason
FROM intents i CROSS JOIN t LEFT JOIN p ON p.chapter = i.parent_id""",
)
def gates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.budget_gates(nodes(spark, sf), chapter=3, case=12).select("id", "in_chapter", "in_case", "reason")


@query(
    "graph_budget_status",
    f"""WITH {N}, {CH}, p AS (SELECT chapter, count(*) AS c FROM ch WHERE {_AUTO} GROUP BY 1)
SELECT g.id AS goal_id, coalesce(p.c, 0) AS intents, (SELECT count(*) FROM n WHERE {_AUTO}) AS case_intents,
 (SELECT count(*) FROM n WHERE kind = 'intent' AND status = 'parked') AS parked FROM goals g LEFT JOIN p ON p.chapter = g.id""",
)
def status(spark: SparkSession, sf: str) -> DataFrame:
    return graph.budget_status(nodes(spark, sf)).drop("case_id")


@query(
    "graph_blackboard",
    f"""WITH {N}, e AS (SELECT DISTINCT 'f' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 = 0),
x AS (SELECT 'fact' AS section, 0 AS g, id, text FROM facts WHERE id IN (SELECT id FROM e)
 UNION ALL SELECT 'doubt', 0, id, text FROM intents WHERE status = 'doubt'
 UNION ALL SELECT 'intent', CASE WHEN {_UNF} THEN 0 ELSE 1 END, id, text FROM intents WHERE status <> 'parked'
 UNION ALL SELECT 'parked', 0, id, text FROM intents WHERE status = 'parked'),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY g, id) AS position, count(*) OVER (PARTITION BY section) AS section_total FROM x)
SELECT section, CAST(position AS INTEGER) AS position, id, text, section_total FROM r""",
)
def board(spark: SparkSession, sf: str) -> DataFrame:
    return graph.blackboard(nodes(spark, sf), edges(spark, sf)).select("section", "position", "id", "text", "section_total")


# ---- report ---------------------------------------------------------------------------------------


@query(
    "report_chapters",
    f"""WITH {N}, c AS (SELECT parent_id, count(*) AS t, count(CASE WHEN status = 'supported' THEN 1 END) AS s FROM intents WHERE status <> 'parked' GROUP BY 1)
SELECT g.id AS goal_id, g.text AS goal_text, coalesce(c.t, 0) AS intents_total, coalesce(c.s, 0) AS intents_supported FROM goals g LEFT JOIN c ON c.parent_id = g.id""",
)
def report_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return report.chapters(nodes(spark, sf)).select("goal_id", "goal_text", "intents_total", "intents_supported")


_F = f"""{H}, {S}, {N}, {A}, {CH}, f AS (SELECT ch.id AS fact_id, ch.text, ch.chapter AS goal_id, a.source_id, a.line_no, a.hit_id, s.host, s.path AS source_path
 FROM ch JOIN a ON a.node_id = ch.id LEFT JOIN s ON s.source_id = a.source_id WHERE ch.kind = 'fact' AND ch.status IN ('supported', 'closed')),
w AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 4 END AS rk FROM h WHERE status = 'accepted')"""


def _report(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    src = sources(spark, sf)
    rows = hits(spark, sf)
    return rows, report.facts(nodes(spark, sf), anchors(spark, sf), src), report.findings(rows, src), src


@query("report_facts", f"WITH {_F} SELECT fact_id, text, goal_id, source_id, line_no, hit_id, host, source_path FROM f")
def report_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)[1].select("fact_id", "text", "goal_id", "source_id", "line_no", "hit_id", "host", "source_path")


# the facts belong to case c1, the candidates to seven cases
_T = f"""WITH {_F}, i AS (SELECT case_id, ts, 'finding' AS kind, '[' || upper(severity) || '] ' || rule_id || ':' || snippet AS text, source_id, line_no FROM w WHERE ts IS NOT NULL
 UNION SELECT h.case_id, h.ts, 'fact', f.text, h.source_id, h.line_no FROM f JOIN h ON h.hit_id = f.hit_id AND h.case_id = 'c1' WHERE h.ts IS NOT NULL),
o AS (SELECT case_id, epoch_us(ts) AS ts, kind, text, source_id, line_no, count(*) OVER c AS timeline_total, epoch_us(min(ts) OVER c) AS window_from, epoch_us(max(ts) OVER c) AS window_to,
 row_number() OVER (PARTITION BY case_id ORDER BY ts, kind, text, source_id, line_no) AS rn FROM i WINDOW c AS (PARTITION BY case_id))"""
_T_COLUMNS = "case_id, ts, kind, text, source_id, line_no, timeline_total, window_from, window_to"


def _timeline(spark: SparkSession, sf: str, limit: int | None) -> DataFrame:
    out = report.timeline(*_report(spark, sf), limit=limit)
    return out.withColumns({c: F.unix_micros(c) for c in ("ts", "window_from", "window_to")})


@query("report_timeline", f"{_T} SELECT {_T_COLUMNS} FROM o")
def report_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf, None).select(_T_COLUMNS.split(", "))


@query("report_timeline_first", f"{_T} SELECT {_T_COLUMNS}, timeline_total > 50 AS truncated FROM o WHERE rn <= 50")
def report_timeline_first(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf, 50).select(*_T_COLUMNS.split(", "), "truncated")


@query(
    "report_findings_first",
    f"""WITH {H}, w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 4 END, created_at, hit_id) AS rn,
 count(*) OVER (PARTITION BY case_id) AS findings_total FROM h WHERE status = 'accepted') SELECT case_id, hit_id, findings_total, findings_total > 500 AS truncated FROM w WHERE rn <= 500""",
)
def report_findings_first(spark: SparkSession, sf: str) -> DataFrame:
    return report.findings(hits(spark, sf), sources(spark, sf), limit=500).select("case_id", "hit_id", "findings_total", "truncated")


@query(
    "report_evidence",
    f"""WITH {_F}, e AS (SELECT case_id, source_id, line_no FROM w UNION ALL
 SELECT 'c1', CASE WHEN f.source_id <> '' THEN f.source_id ELSE h.source_id END, CASE WHEN f.source_id <> '' THEN f.line_no ELSE h.line_no END
 FROM f LEFT JOIN h ON h.hit_id = f.hit_id AND h.case_id = 'c1'),
r AS (SELECT case_id, source_id, line_no, count(*) AS refs FROM e WHERE source_id <> '' GROUP BY ALL)
SELECT r.case_id, r.source_id, r.line_no, r.refs, s.host, count(*) OVER (PARTITION BY r.case_id) AS evidence_total FROM r LEFT JOIN s USING (source_id)""",
)
def report_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return report.evidence(*_report(spark, sf)).select("case_id", "source_id", "line_no", "refs", "host", "evidence_total")


# ---- audit chain ----------------------------------------------------------------------------------


@query(
    "audit_entry_hash",
    """SELECT event_id AS seq, sha256(concat_ws(chr(0), CAST(event_id AS VARCHAR), 'c1', strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
 CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z', 'u' || CAST(user_id AS VARCHAR), event_type, '', props, 'p')) AS entry_hash
FROM events""",
)
def entry_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).withColumn("prev_hash", F.lit("p")).select("seq", audit.entry_hash().alias("entry_hash"))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.lit("c1").alias("case_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"),
        F.lit("").alias("scope"), F.col("props").alias("detail_json"),
    )


@query(
    "audit_chain_links",
    """WITH e AS (SELECT event_id AS seq, 'e' || CAST(event_id AS VARCHAR) AS entry_hash,
  CASE WHEN event_id = 0 THEN 'GENESIS' WHEN event_id % 250 = 3 THEN 'cut' ELSE 'e' || CAST(event_id - 1 AS VARCHAR) END AS prev_hash FROM events),
l AS (SELECT *, coalesce(lag(entry_hash) OVER (ORDER BY seq), 'GENESIS') AS want FROM e)
SELECT seq, CASE WHEN prev_hash <> want THEN 'link' ELSE 'content' END AS problem FROM l""",
)
def chain_links(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    rows = _audit(spark, sf).withColumns(
        {
            "entry_hash": F.concat(F.lit("e"), seq.cast("string")),
            "prev_hash": F.when(seq == 0, "GENESIS").when(seq % 250 == 3, "cut").otherwise(F.concat(F.lit("e"), (seq - 1).cast("string"))),
        }
    )
    return audit.chain_breaks(rows, chunk=1000)


def _sealed_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Real chains, one per user: every entry's hash goes into the next.  Some are tampered with afterwards."""
    place = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("case_id"), (F.row_number().over(place) - 1).cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit("a").alias("actor"), F.col("event_type").alias("action"), F.lit("").alias("scope"),
        F.col("props").alias("detail_json"),
    )
    fields = ["case_id", "seq", "ts", "actor", "action", "scope", "detail_json"]

    def seal(done: Column, entry: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["entry_hash"], F.lit("GENESIS"))
        digest = F.sha2(
            F.concat_ws(
                "\u0000", entry["seq"].cast("string"), entry["case_id"], rfc3339_nano(entry["ts"]), entry["actor"], entry["action"],
                entry["scope"], entry["detail_json"], before,
            ),
            256,
        )
        return F.concat(done, F.array(F.struct(*[entry[f].alias(f) for f in fields], before.alias("prev_hash"), digest.alias("entry_hash"))))

    layout = "array<struct<case_id:string,seq:bigint,ts:timestamp,actor:string,action:string,scope:string,detail_json:string,prev_hash:string,entry_hash:string>>"
    chains = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[f for f in fields if f != "seq"]))).alias("e"))
    return chains.select(F.inline(F.aggregate("e", F.array().cast(layout), seal)))


# a third of the chains has an entry changed, another third a link cut, where they are long enough
@query(
    "audit_chains_verified",
    """WITH n AS (SELECT 'c' || CAST(user_id AS VARCHAR) AS case_id, user_id % 3 AS kind, count(*) AS entries FROM events GROUP BY user_id)
SELECT case_id, CAST(entries AS BIGINT) AS entries, CASE WHEN entries > 4 AND kind = 1 THEN 4 WHEN entries > 3 AND kind = 2 THEN 3 END::BIGINT AS first_break,
 CASE WHEN entries > 4 AND kind = 1 THEN 'content' WHEN entries > 3 AND kind = 2 THEN 'link' END AS problem,
 NOT ((entries > 4 AND kind = 1) OR (entries > 3 AND kind = 2)) AS intact FROM n""",
)
def chains_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of each chain's first six entries and of those appended later, verified together."""
    kind = F.substring("case_id", 2, 99).cast("bigint") % 3
    rows = _sealed_chains(spark, sf).withColumns(
        {
            "action": F.when((kind == 1) & (F.col("seq") == 4), "forged").otherwise(F.col("action")),
            "prev_hash": F.when((kind == 2) & (F.col("seq") == 3), "cut").otherwise(F.col("prev_hash")),
        }
    )
    stored = audit.segment_digests(rows.filter("seq < 6"), size=4)
    appended = audit.segment_digests(rows.filter("seq >= 6"), size=4)
    return audit.verify_segments(stored.unionByName(appended))


# entries whose hash leaves the previous one out can be valid without a running chain of digests
_SEALED = """s AS (SELECT event_id AS seq, ts, 'u' || CAST(user_id AS VARCHAR) AS actor, event_type, props,
  'GENESIS' AS prev_hash FROM events),
t AS (SELECT *, CASE WHEN seq % 100 = 7 THEN NULL WHEN seq % 100 = 9 THEN 'wrong' ELSE sha256(concat_ws(chr(0), CAST(seq AS VARCHAR), 'c1',
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z',
  actor, event_type, '', props, CASE WHEN seq % 100 = 11 THEN '' ELSE prev_hash END)) END AS entry_hash FROM s)"""


def _sealed(spark: SparkSession, sf: str) -> DataFrame:
    """One-entry chains with valid hashes, and entries without a hash, with a wrong one and without a link."""
    rows = _audit(spark, sf).withColumn("prev_hash", F.when(F.col("seq") % 100 != 11, audit.GENESIS))
    seq = F.col("seq") % 100
    return rows.withColumn("entry_hash", F.when(seq == 7, F.lit(None).cast("string")).when(seq == 9, "wrong").otherwise(audit.entry_hash()))


@query(
    "audit_entries_sealed",
    f"WITH {_SEALED} SELECT seq, seq % 100 NOT IN (7, 9) AS sound FROM t",
)
def entries_sealed(spark: SparkSession, sf: str) -> DataFrame:
    return _sealed(spark, sf).select("seq", F.col("entry_hash").eqNullSafe(audit.entry_hash()).alias("sound"))


@query(
    "audit_verify",
    "SELECT count(*) AS entries, 1 AS first_break, 'link' AS problem, false AS intact FROM events",
)
def verify(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verify_chain(_sealed(spark, sf), chunk=1000)


# ---- duplicates -----------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("id"), "text")


@query(
    "dedup_exact_groups",
    """WITH t AS (SELECT lang AS case_id, doc_id AS id, regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]', '', 'g') AS norm FROM documents)
SELECT case_id, sha256(norm) AS digest, min(id) AS first_id, count(*) AS copies FROM t WHERE norm <> '' GROUP BY case_id, norm HAVING count(*) > 1""",
)
def exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_groups(_texts(spark, sf))


@query(
    "dedup_keywords",
    """WITH t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS kw FROM documents)
SELECT id, CAST(len(kw) AS INTEGER) AS keyword_count, md5(array_to_string(list_sort(kw), ',')) AS digest FROM t""",
)
def keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    kw = dedup.keywords(F.col("text"))
    return _texts(spark, sf).select("id", F.size(kw).alias("keyword_count"), F.md5(F.array_join(F.array_sort(kw), ",")).alias("digest"))


#: Texts are taken one by one in their order; ``acc`` holds the places of those accepted so far, per threshold.
DEDUP_SQL = """WITH RECURSIVE k AS (
  SELECT lang AS case_id, doc_id AS id, regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]', '', 'g') AS norm,
    list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS kw, row_number() OVER (ORDER BY lang, doc_id) AS pos FROM documents),
p AS (
  SELECT a.pos, b.pos AS other, a.norm = b.norm AS exact, len(list_intersect(a.kw, b.kw)) AS c, len(a.kw) + len(b.kw) AS s
  FROM k a JOIN k b ON a.case_id IS NOT DISTINCT FROM b.case_id AND b.pos < a.pos
  WHERE a.norm <> '' AND b.norm <> '' AND (a.norm = b.norm OR 2 * least(len(a.kw), len(b.kw)) >= greatest(len(a.kw), len(b.kw)))),
l AS (SELECT pos, other, exact, CASE WHEN exact THEN 1.0::DOUBLE WHEN s > c THEN c / (s - c) ELSE 0.0 END AS score FROM p),
t AS (SELECT unnest([%s]::DOUBLE[]) AS threshold),
n AS (
  SELECT threshold, k.pos, list(other) FILTER (WHERE exact OR score >= threshold) AS others
  FROM t CROSS JOIN k LEFT JOIN l USING (pos) GROUP BY threshold, k.pos),
r(threshold, pos, acc) AS (
  SELECT threshold, 0::BIGINT, []::BIGINT[] FROM t
  UNION ALL SELECT r.threshold, n.pos, CASE WHEN list_has_any(acc, coalesce(n.others, [])) THEN acc ELSE list_append(acc, n.pos) END
  FROM r JOIN n ON n.threshold = r.threshold AND n.pos = r.pos + 1),
a AS (SELECT threshold, unnest(acc) AS other FROM r WHERE pos = (SELECT max(pos) FROM k)),
h AS (
  SELECT a.threshold, l.pos, max(exact) AS exact, max(score) AS score, arg_min(other, (NOT exact, -score, other)) AS other
  FROM l JOIN a USING (other) WHERE exact OR score >= a.threshold GROUP BY a.threshold, l.pos),
v AS (
  SELECT t.threshold, k.case_id, k.id, CASE WHEN h.exact THEN 'exact' WHEN h.pos IS NOT NULL THEN 'similar' ELSE 'none' END AS verdict,
    b.id AS blocked_by, h.score
  FROM t CROSS JOIN k LEFT JOIN h ON h.threshold = t.threshold AND h.pos = k.pos LEFT JOIN k b ON b.pos = h.other)
"""


@query("dedup_replay", DEDUP_SQL % "0.85" + "SELECT case_id, id, verdict, blocked_by, score FROM v")
def replay(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.replay(_texts(spark, sf))


# ---- file records ---------------------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lit("v").alias("volume"), key.alias("id"),
        F.when(key % 97 == 13, key + 1_000_000_000).otherwise(F.floor(key / 3)).cast("bigint").alias("parent_id"),
        F.concat(F.col("p_name"), F.lit("_"), key.cast("string")).alias("name"), (key % 7 != 3).alias("is_dir"),
        F.timestamp_seconds(F.lit(1_600_000_000) + key).alias("si_created"),
        F.timestamp_seconds(F.lit(1_600_000_000) + key + F.col("p_size") * 3).alias("fn_created"),
        (F.col("p_size") % 3).alias("links"), (key % 2 == 0).alias("in_use"),
    )


_REC = """WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 13 THEN p_partkey + 1000000000 ELSE CAST(floor(p_partkey / 3) AS BIGINT) END AS parent_id,
 p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, p_partkey % 7 <> 3 AS is_dir, p_size * 3 AS delta, p_size % 3 AS links, p_partkey % 2 = 0 AS in_use FROM part),
d AS (SELECT id, '' AS path FROM r WHERE is_dir AND id = parent_id
 UNION ALL SELECT r.id, CASE WHEN d.path = '' THEN r.name ELSE d.path || '\\' || r.name END FROM r JOIN d ON r.parent_id = d.id WHERE r.is_dir AND r.id <> r.parent_id),
f AS (SELECT r.*, CASE WHEN d.id IS NULL THEN NULL WHEN d.path = '' THEN r.name ELSE d.path || '\\' || r.name END AS path FROM r LEFT JOIN d ON d.id = r.parent_id)"""


@query("file_record_paths", f"{_REC} SELECT id, path FROM f")
def record_paths(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_paths(_records(spark, sf)).select("id", "path")


@query(
    "file_record_tampering",
    f"{_REC} SELECT id, path, CAST(delta AS DOUBLE) AS delta_seconds FROM f WHERE delta > 60 AND links <= 1",
)
def tampering(spark: SparkSession, sf: str) -> DataFrame:
    return files.tampered_candidates(files.file_paths(_records(spark, sf))).select("id", "path", "delta_seconds")


@query(
    "file_record_tampering_directories",
    f"""{_REC}, t AS (SELECT CASE WHEN contains(path, '\\') THEN regexp_replace(path, '\\\\[^\\\\]*$', '') ELSE '(root or unresolved)' END AS dir FROM f WHERE delta > 60 AND links <= 1),
c AS (SELECT coalesce(dir, '(root or unresolved)') AS dir, count(*) AS count FROM t GROUP BY 1)
SELECT dir, count, CAST(row_number() OVER (ORDER BY count DESC, dir) AS INTEGER) AS rank FROM c QUALIFY rank <= 20""",
)
def tampering_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return files.tampered_directories(files.file_paths(_records(spark, sf))).select("dir", "count", "rank")
