import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quernlog.operators import chains, cross, host, web

T0 = datetime(2026, 8, 14, 2, 0, 0)


def at(seconds):
    return None if seconds is None else (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S.%f")


def fold(rows, n, window, window_lines, latest):
    """Plain reference of the two chains; rows are (line, seconds or None, fail)."""
    out, fails, first, nth, last = [], 0, 0, None, None
    for line, t, fail in rows:
        if fail:
            fails += 1
            first = line if fails == 1 else first
            nth = (line, t) if fails == n else nth
            last = (line, t)
        elif fails >= n:
            anchor = last if latest else nth
            if t is not None and anchor[1] is not None:
                ok = abs(t - anchor[1]) <= window
            else:
                ok = latest or line - nth[0] <= window_lines
            if ok:
                out.append((line, fails, first, nth[0], last[0]))
                fails, nth, last = 0, None, None
    return out


def random_rows(rng, size, ordered):
    t, rows = 0, []
    for i in range(size):
        t += rng.choice([0, 1, 5, 40])
        when = t if ordered else rng.randint(0, 400)
        rows.append((i * rng.choice([1, 1, 2]) + i + 1, None if rng.random() < 0.15 else when, rng.random() < 0.6))
    seen, uniq = set(), []
    for r in sorted(rows, key=lambda x: x[0]):
        if r[0] not in seen:
            seen.add(r[0])
            uniq.append(r)
    return uniq


def test_bruteforce_matches_fold_for_ordinary_and_oversized_groups(events):
    rng = random.Random(5)
    data = {f"203.0.113.{i}": random_rows(rng, 90, ordered=i % 2 == 0) for i in range(6)}
    rows, line_of = [], 0
    for k, (ip, seq) in enumerate(data.items()):
        rows += [(f"s{k}", line, at(t), {"src_ip": ip, "status": "401" if fail else "200"}) for line, t, fail in seq]
    df = events(rows).cache()
    want = sorted((ip, *w) for ip, seq in data.items() for w in fold(seq, 3, 60, 12, latest=False))
    for group_rows in (10_000, 1):
        found = chains.bruteforce_chain(df, fail_threshold=3, window_seconds=60, window_lines=12, group_rows=group_rows, chunk=16)
        got = sorted((r.matched_value, r.line_no, r.fail_count, r.fail_first_line, r.fail_nth_line) for r in found.collect())
        assert got == [w[:5] for w in want]
    assert want


def test_auth_chain_matches_fold_for_ordinary_and_oversized_groups(events):
    rng = random.Random(9)
    rows, want = [], []
    for k in range(6):
        seq = random_rows(rng, 90, ordered=k % 2 == 0)
        want += [(f"a{k}", *w) for w in fold(seq, 3, 60, 0, latest=True)]
        rows += [
            (f"s{k}", line, at(t), {"event_id": 4625 if fail else 4624, "computer": "PC", "data": {"TargetUserName": f"a{k}"}}, "windows_event_log")
            for line, t, fail in seq
        ]
    df = events(rows).cache()
    for group_rows in (10_000, 1):
        found = chains.auth_chain(df, fail_threshold=3, window_seconds=60, group_rows=group_rows, chunk=16)
        got = sorted(
            (r.matched_value, r.line_no, r.fail_count, r.fail_first_line, r.fail_nth_line, r.fail_last_line) for r in found.collect())
        assert got == sorted(want)
    assert want


def web_rows(seq, ip="203.0.113.10"):
    return [("s", i + 1, at(t), {"src_ip": ip, "status": s}) for i, (t, s) in enumerate(seq)]


def test_bruteforce_boundaries(events):
    few = web_rows([(i, "401") for i in range(9)] + [(10, "200")])
    assert chains.bruteforce_chain(events(few)).count() == 0
    late = web_rows([(i, "401") for i in range(10)] + [(9 + 601, "200")])
    assert chains.bruteforce_chain(events(late)).count() == 0
    row = chains.bruteforce_chain(events(web_rows([(None, "401")] * 10 + [(None, "200")]))).collect()[0]
    assert (row.window_basis, row.window_actual, row.evidence_grade) == ("lines", 1.0, "strong")


def test_long_campaign_hits_auth_chain_only(events):
    seq = [(i * 86400, True) for i in range(12)] + [(11 * 86400 + 5, False)]
    win = [("s", i + 1, at(t), {"event_id": 4625 if f else 4624, "computer": "P", "data": {"TargetUserName": "adm"}}, "windows_event_log") for i, (t, f) in enumerate(seq)]
    assert chains.auth_chain(events(win)).count() == 1
    assert chains.bruteforce_chain(events(web_rows([(t, "401" if f else "200") for t, f in seq]))).count() == 0
    machine = [(*r[:3], {**r[3], "data": {"TargetUserName": "PC$"}}, r[4]) for r in win]
    assert chains.auth_chain(events(machine)).count() == 0


def test_beacon_and_chunking(events):
    exact = [("s", i * 3 + 1, at(i * 300), {"src_ip": "203.0.113.1"}) for i in range(20)]
    jitter = [("s", i * 3 + 2, at(i * 300 + (i * 7919) % 290), {"src_ip": "203.0.113.2"}) for i in range(20)]
    df = events(exact + jitter + [("s", 100, None, {"src_ip": "203.0.113.1"})])
    for chunk in (4, 1 << 22):
        rows = web.beacon_periodicity(df, chunk=chunk).collect()
        assert [(r.matched_value, r.samples, r.intervals, r.cv, r.events_without_ts, r.line_no) for r in rows] == [
            ("203.0.113.1", 20, 19, 0.0, 1, 58)]
    a = {r.matched_value: round(r.cv, 9) for r in web.beacon_periodicity(df, max_cv=9.0, chunk=5).collect()}
    b = {r.matched_value: round(r.cv, 9) for r in web.beacon_periodicity(df, max_cv=9.0).collect()}
    assert a == b and len(a) == 2


def test_outlier_tie_and_even_median(events):
    sizes = [100, 100, 102, 104, 1000, 1000, 10]
    rows = [("s", i + 1, None, {"path": "/a", "bytes": b}) for i, b in enumerate(sizes)] + [("s", 50, None, {"path": "/b", "bytes": 5})]
    r = web.size_outlier(events(rows), min_samples=7).collect()
    assert len(r) == 1 and (r[0].line_no, r[0].median_bytes, r[0].outlier_count) == (5, 102.0, 3)
    assert [o["line_no"] for o in r[0].outliers] == [5, 6, 7]
    even = [("s", i + 1, None, {"path": "/a", "bytes": b}) for i, b in enumerate([-5, 0, 1, 2, 50, 60])]
    assert web.size_outlier(events(even), min_samples=3).collect()[0].median_bytes == 1.5


def test_sequence_uses_last_first_step(events):
    rows = web_rows([(0, "401"), (1, "401"), (2, "403"), (100, "200"), (200, "401"), (501, "200")])
    assert chains.sequence_chain(events(rows), key_fields=["src_ip"], min_first_step_count=3).count() == 0
    rows = web_rows([(0, "401"), (1, "401"), (2, "403"), (302, "200")])
    assert chains.sequence_chain(events(rows), key_fields=["src_ip"], min_first_step_count=3).collect()[0].line_no == 4


def test_host_rows(events):
    def win(line, eid, **data):
        return ("s", line, at(line), {"event_id": str(eid), "computer": "PC", "data": data}, "windows_event_log")

    df = events([
        win(1, 4698, TaskName="\\Microsoft\\U", TaskContent="<Command> C:\\Temp\\a.exe </Command><Arguments>-x</Arguments>"),
        win(2, 4698, TaskName="\\Own", TaskContent="<Command>C:\\Temp\\a.exe</Command>"),
        win(3, 7045, ServiceName="s", ImagePath="C:\\ProgramData\\a.exe"), win(4, 7045, ServiceName="t", ImagePath="C:\\Windows\\x.exe"),
        win(5, 7045), win(6, 4688, NewProcessName="C:\\Windows\\System32\\svchost.exe"), win(7, 4688, NewProcessName="C:/x/svch0st.exe\\svch0st.exe"),
        win(8, 4688, NewProcessName="D:\\svchost.exe"), win(9, 4648, TargetServerName="LocalHost"), win(10, 4648, TargetServerName="srv", TargetUserName="u"),
        win(11, 4663, ObjectName="\\REGISTRY\\MACHINE\\SAM", ProcessName="C:\\m.exe"), win(12, 4663, ObjectName="HKLM\\SAM", ProcessName="C:\\lsass.exe"),
    ])
    assert [(r.line_no, r.command, r.arguments) for r in host.persistence_task(df).collect()] == [(1, "C:\\Temp\\a.exe", "-x")]
    assert {r.line_no: r.evidence_grade for r in host.service_install(df).collect()} == {3: "strong", 4: "suspect"}
    assert {r.line_no: (r.similarity, r.evidence_grade) for r in host.process_tree(df).collect()} == {7: ("edit1", "suspect"), 8: ("exact", "strong")}
    assert {r.line_no: r.evidence_grade for r in host.credential_face(df).collect()} == {10: "suspect", 11: "strong"}


def test_cross_entities(events):
    rows = [("a", 1, at(5), {"src_ip": "203.0.113.7"}), ("b", 1, at(1), {"src_ip": "203.0.113.7"}, "web_access", "h2"),
            ("a", 2, at(0), {"src_ip": "192.168.1.5"}), ("b", 2, at(0), {"src_ip": "192.168.1.5"}, "web_access", "h2"),
            ("c", 1, at(0), {"src_ip": "203.0.113.8"}), ("d", 1, at(0), {"src_ip": "203.0.113.8"}, "web_access", "")]
    df = events(rows)
    multi = {r.matched_value: r.source_id for r in cross.cross_entity_multi_source(df).collect()}
    assert multi == {"203.0.113.7": "b", "203.0.113.8": "c"}
    assert [r.matched_value for r in cross.cross_host_entity(df).collect()] == ["203.0.113.7"]
    assert cross.unmodeled_sources(df.select("case_id", "source_id", "host").distinct()).collect()[0][1] == 1


def test_time_cluster_matches_two_pointers(events):
    rng = random.Random(3)
    times = sorted(rng.randint(0, 3000) for _ in range(300))
    rows = [("s", i + 1, at(t), {"path": f"/d/{i}.x{i % 3}", "reason_hex": "0x00000100"}, "usn_journal") for i, t in enumerate(times)]
    best = max((sum(1 for u in times if t <= u <= t + 60), -t) for t in times)
    r = host.time_cluster(events(rows), window_seconds=60, min_events=2).collect()[0]
    assert (r.events_in_window, int((r.ts - T0).total_seconds())) == (best[0], -best[1])
    ext = host.time_cluster_extensions(events(rows), window_seconds=60, min_events=2).agg(F.sum("events")).collect()[0][0]
    assert ext == best[0]


def test_time_cluster_of_many_instants_in_a_window(spark):
    def changes(n):
        rows = spark.range(n).selectExpr(
            "'c1' case_id", "'s' source_id", "id + 1 line_no", "timestamp_micros(1700000000000000 + id * 1000) ts", "'event' kind", "'usn_journal' log_type",
            "'h1' host", "'{}' fields", "'' raw", "'0x00000100' f_reason_hex", "'/d/a.x' f_path", "'' x_reason_hex", "'' x_path",
        )
        began = time.time()
        r = host.time_cluster(rows, window_seconds=3600, min_events=2).collect()[0]
        return r.events_in_window, r.line_no, r.last_line, time.time() - began

    changes(100)
    assert changes(60_000)[:3] == (60_000, 1, 60_000)
    # all instants are in one window: counting each window anew would take the square of them
    assert changes(60_000)[3] < 60
