"""No row is lost: caps only where asked for, unregistered sources, cases side by side, renewed sources."""

from pyspark.sql import functions as F

from quernlog.operators import audit, files, graph, report, rules, stats
from quernlog.operators.search import SearchParams, line_range, search
from quernlog.sources import linux_logs
from quernlog.sources.records import canonical_records, replace_source, to_events, write_events
from quernlog.streaming import incremental

BASE = {"target": "event", "severity": "low", "title": "t", "min_hosts": 0, "max_hits": 2}


def test_same_field_conditions_are_alternatives(events):
    picked = [
        {**BASE, "id": "two", "match": {"a_prefix": ["zz"], "a_endswith": ["the end"], "b": ["x"]}},
        {**BASE, "id": "one", "match": {"a_eq": ["longest of all"], "a_contains": ["q"]}},
    ]
    df = events([
        ("s", 1, None, {"a": "zz top", "b": "x"}), ("s", 2, None, {"a": "at the END", "b": "x"}), ("s", 3, None, {"a": "zz", "b": "y"}),
        ("s", 4, None, {"a": "a q"}), ("s", 5, None, {"a": "zz the end", "b": "x"}), ("s", 6, None, {"a": "Longest of all"}),
    ])
    got = {(r.rule_id, r.line_no): r.matched_value for r in rules.event_rule_hits(df, picked).collect()}
    assert got == {("two", 1): "zz", ("two", 2): "the end", ("two", 5): "zz", ("one", 4): "q", ("one", 6): "longest of all"}


def test_every_match_of_a_batch_is_stored(spark, events, tmp_path):
    batch = events([("s", i + 1, None, {"method": "TRACE"}) for i in range(600)])
    hits, ents = str(tmp_path / "h"), str(tmp_path / "e")
    incremental.process_batch(hits, ents)(batch, 0)
    assert spark.read.parquet(hits).count() == 600


def test_outcome_without_and_with_any_cap(events):
    df = events([(s, i + 1, None, {"method": "TRACE"}) for s in ("s", "t") for i in range(0, 9000, 30)])
    hits = rules.event_rule_hits(df).cache()
    assert {r.outcome for r in rules.with_outcome(hits, None).collect()} == {"new"}
    for cap in (1, 299, 300, 301, 450, 600, 5000):
        rows = rules.with_outcome(hits, None, cap).orderBy("source_id", "line_no").collect()
        assert [r.outcome for r in rows] == ["new" if k < cap else "truncated" for k in range(600)]
    some = rules.with_outcome(hits, None, {"another": 3}).collect()
    assert {r.outcome for r in some} == {"new"}


def test_events_of_unregistered_and_shared_sources(spark, lines):
    records = linux_logs.parse_yum(lines(["Mar 12 16:46:24 Installed: a-1", "junk"], "known").union(lines(["junk"], "unknown")), "2026-04-01")
    sources = spark.createDataFrame(
        [("c1", "known", "UTC", "yum", "log", "h"), ("c2", "other", "UTC", "yum", "log", "h")],
        "case_id string, source_id string, tz string, log_type string, artifact_type string, host string",
    )
    rows = to_events(records, sources).collect()
    assert sorted((r.source_id, r.line_no, r.case_id) for r in rows) == [("known", 1, "c1"), ("known", 2, "c1"), ("unknown", 1, None)]
    assert canonical_records(records, sources).count() == 3
    shared = sources.union(spark.createDataFrame([("c2", "known", "UTC+8", "yum", "log", "h")], sources.schema))
    with_case = records.withColumn("case_id", F.lit("c2"))
    two = to_events(with_case, shared).collect()
    assert len(two) == 3 and str(next(r.ts for r in two if r.line_no == 1 and r.source_id == "known")) == "2026-03-12 08:46:24"


def test_renewing_one_source_leaves_the_others(spark, tmp_path):
    schema = "case_id string, source_id string, line_no bigint, ts timestamp, kind string, raw string"
    path = str(tmp_path / "events")
    rows = [("c", f"s{k}", i, None, "event", "old") for k in range(200) for i in (1, 2)]
    write_events(spark.createDataFrame(rows, schema), path)
    fresh = spark.createDataFrame([("c", "s7", 1, None, "event", "new")], schema)
    replace_source(spark, path, fresh)
    got = sorted((r.source_id, r.line_no, r.raw) for r in spark.read.parquet(path).collect())
    assert got == sorted([(s, i, t) for _, s, i, _, _, t in rows if s != "s7"] + [("s7", 1, "new")])


def test_report_counts_each_case_on_its_own(spark):
    schema = "case_id string, hit_id bigint, source_id string, line_no bigint, rule_id string, severity string, status string, snippet string, ts timestamp, created_at timestamp"
    at = "cast('2026-01-01' as timestamp) + make_interval(0, 0, 0, 0, 0, 0, hit_id)"
    rows = [("c1" if k < 60 else "c2", k, "s", k, "r", "high", "accepted", "x", None, None) for k in range(70)]
    hits = spark.createDataFrame(rows, schema).withColumn("ts", F.expr(at)).withColumn("created_at", F.expr(at))
    sources = spark.createDataFrame([("s", "h", "p", "d")], "source_id string, host string, path string, sha256 string")
    none = spark.createDataFrame([], "case_id string, fact_id string, text string, hit_id bigint, source_id string, line_no bigint")
    found = report.findings(hits, sources)
    assert found.count() == 70 and not any(r.truncated for r in found.collect())
    cut = report.timeline(hits, none, found, sources, limit=50).collect()
    by_case = {c: [r for r in cut if r.case_id == c] for c in ("c1", "c2")}
    assert len(by_case["c1"]) == 50 and len(by_case["c2"]) == 10
    assert {(r.timeline_total, r.truncated) for r in by_case["c1"]} == {(60, True)} and {(r.timeline_total, r.truncated) for r in by_case["c2"]} == {(10, False)}
    assert report.evidence(hits, none, found, sources).count() == 70
    assert {r.findings_total for r in report.findings(hits, sources, limit=5).collect()} == {60, 10}


def test_audit_nulls_break_the_chain(spark):
    fields = "seq bigint, case_id string, ts timestamp, actor string, action string, scope string, detail_json string, prev_hash string"
    first = spark.createDataFrame([(1, "c", None, "a", "x", "", None, audit.GENESIS)], fields).withColumn("entry_hash", audit.entry_hash())
    one = first.collect()[0]
    second = spark.createDataFrame([(2, "c", None, None, "x", "y", None, one.entry_hash)], fields).withColumn("entry_hash", audit.entry_hash())
    good = audit.verify_chain(first.union(second)).collect()[0]
    assert good.intact and good.entries == 2
    for column, problem in (("entry_hash", "content"), ("prev_hash", "link"), ("scope", "content")):
        broken = first.union(second.withColumn(column, F.lit(None).cast("string")))
        row = audit.verify_chain(broken).collect()[0]
        assert not row.intact and (row.first_break, row.problem) == (2, problem)
    moved = first.union(second.withColumns({"actor": F.lit("x"), "action": F.lit(None).cast("string")}))
    assert not audit.verify_chain(moved).collect()[0].intact


def test_pages_counts_and_ranges_are_whole(events, lines):
    df = events([(f"s{k % 3}", k, f"2026-01-01 {k % 24:02d}:00:00", {"status": str(k)}) for k in range(1200)])
    assert search(df, SearchParams("c1")).count() == 1200 and stats.event_counts(df, "c1", "status").count() == 1200
    page = search(df, SearchParams("c1", limit=2, after=("s0", 1194))).collect()
    assert [(r.source_id, r.line_no) for r in page] == [("s0", 1197), ("s1", 1)]
    assert line_range(lines(["x"] * 1500), "s", 1, 1500).count() == 1500
    assert search(df, SearchParams("c1", source_ids=tuple(f"s{k}" for k in range(6000)))).count() == 1200


def test_deep_chapters_and_paths(spark):
    rows = [("c", "g", "goal", None, "open", "ai", "")] + [("c", f"n{k}", "intent", "g" if k == 0 else f"n{k - 1}", "open", "ai", "") for k in range(40)]
    rows += [("c", "loop1", "intent", "loop2", "open", "ai", ""), ("c", "loop2", "intent", "loop1", "open", "ai", "")]
    nodes = spark.createDataFrame(rows, "case_id string, id string, kind string, parent_id string, status string, created_by string, text string")
    got = {r.id: r.chapter for r in graph.with_chapter(nodes).collect()}
    assert all(got[f"n{k}"] == "g" for k in range(40)) and got["loop1"] is None
    tree = [("v", 0, 0, "root", True)] + [("v", k, k - 1, f"d{k}", True) for k in range(1, 101)] + [("v", 900, 901, "a", True), ("v", 901, 900, "b", True)]
    paths = {r.id: r.path for r in files.directory_paths(spark.createDataFrame(tree, "volume string, id bigint, parent_id bigint, name string, is_dir boolean")).collect()}
    assert paths[100] == "\\".join(f"d{k}" for k in range(1, 101)) and 900 not in paths


def test_bad_log_lines_are_skipped(lines):
    def kinds(df):
        return [r.kind for r in df.orderBy("line_no").collect()]

    assert kinds(linux_logs.parse_syslog(lines([
        "2026-01-01T10:00:00.5+08:00 h sshd[1]: ok", "2026-01-01T10:00:00+8 h sshd: x", "2026-01-01 10:00:00 h two words: x", "Jan 1 10:00:00 h t: m",
        "Jan 100 10:00:00 h t: m", "Janu 1 10:00:00 h t: m", "Jan 1 10:00 h t: m", "Jan 1 10:00:00 h no colon", " Jan 1 10:00:00 h t: m", "",
    ]), "messages", "2026-02-01"))== ["event", "skip", "skip", "event", "skip", "skip", "skip", "skip", "skip", "skip"]
    rows = linux_logs.parse_syslog(lines(["Jan 1 10:00:00 h a[x]: m", "Jan 1 10:00:00 h b[12]:  two  blanks", "Jan 1 10:00:00 h c[1][2]: m"]), "messages", "2026-02-01")
    assert [(r.norm.tag, r.norm.pid, r.norm.message) for r in rows.orderBy("line_no").collect()] == [("a[x]", None, "m"), ("b", "12", "two  blanks"), ("c[1]", "2", "m")]
    assert kinds(linux_logs.parse_journal_iso(lines(["2026-07-28T17:06:30+0800 h u: m", "2026-07-28T17:06:30 h u: m", "2026-07-28 17:06:30+0800 h u: m", "x"]))) == ["event", "skip", "skip", "skip"]
    assert kinds(linux_logs.parse_journal_short(lines(["7月 28 17:17:44 h u: m", "777月 28 17:17:44 h u: m", "月 28 17:17:44 h u: m"]))) == ["event", "skip", "skip"]
    assert kinds(linux_logs.parse_last(lines([
        "bob pts/0 10.0.0.1 Mon Jan  5 10:00:00 2026 - Mon Jan  5 11:00:00 2026  (01:00)", "wtmp begins Mon Jan  5 10:00:00 2026", "bob pts/0 10.0.0.1 Mon 5 Jan 10:00:00 2026", "x",
    ]))) == ["event", "skip", "skip", "skip"]
    assert kinds(linux_logs.parse_lastlog(lines([
        "Username Port From Latest", "root pts/0 10.0.0.1 Mon Jan 5 10:00:00 +0800 2026", "bin **Never logged in**", "root pts/0 Mon Jan 5 10:00:00 +0800 2026", "x",
    ]))) == ["skip", "event", "event", "skip", "skip"]
    assert kinds(linux_logs.parse_yum(lines(["Mar 12 16:46:24 Installed: a", "Mar 12 16:46 Installed", "12 Mar 16:46:24 x y"]), "2026-04-01")) == ["event", "skip", "skip"]
    said = linux_logs.parse_syslog(lines([
        f"Jan 1 10:00:00 h sshd[1]: {m}" for m in (
            "Accepted password for invalid user bob from 1.2.3.4 port 1", "Failed none for root from 1.2.3.4", "Failed password root from 1.2.3.4",
            "Invalid user x from 1.2.3.4", "Invalid user  from 1.2.3.4", "error: pam_unix(sshd:session): session closed for user amy",
        )
    ]), "messages", "2026-02-01")
    assert [(r.norm.action, r.norm.user, r.norm.src_ip) for r in said.orderBy("line_no").collect()] == [
        ("accepted", "bob", "1.2.3.4"), ("failed", "root", "1.2.3.4"), (None, None, None), ("invalid_user", "x", "1.2.3.4"), (None, None, None),
        ("session_closed", "amy", None),
    ]
