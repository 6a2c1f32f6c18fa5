import itertools
import pathlib
import random
import re

from pyspark.sql import functions as F

from quernlog.operators import audit, dedup, entities, files, review, rules
from quernlog.operators.search import page_range
from quernlog.session import ensure_checkpoint_dir
from quernlog.streaming import incremental


def test_rule_semantics(events):
    base = {"target": "event", "severity": "low", "title": "t", "min_hosts": 0, "max_hits": 2}
    picked = [
        {**base, "id": "two-fields", "match": {"a": ["X", "yy"], "b_eq": ["Done"]}},
        {**base, "id": "same-field", "match": {"a_prefix": ["zz"], "a_endswith": ["end"]}},
        {**base, "id": "raw", "match": {"raw_contains": ["NEEDLE"]}},
    ]
    df = events([
        ("s", 1, None, {"a": "has YY", "b": "DONE"}), ("s", 2, None, {"a": "has yy", "b": "done!"}),
        ("s", 3, None, {"a": "the END"}), ("s", 4, None, {"c": "a needle"}), ("s", 5, None, {"a": "yyx", "b": "done"}),
    ])
    got = {(r.rule_id, r.line_no): (r.matched_field, r.matched_value) for r in rules.event_rule_hits(df, picked).collect()}
    assert got == {
        ("two-fields", 1): ("a", "yy"), ("same-field", 3): ("a", "end"), ("raw", 4): ("raw", "needle"), ("two-fields", 5): ("a", "x"),
    }


def test_nested_data_text_matches(events):
    df = events([
        ("s", 1, None, {"channel": "Security", "event_id": 4726, "data": {"SubjectUserSid": "S-1-5-18"}}),
        ("s", 2, None, {"channel": "System", "event_id": 7045, "data": {"ImagePath": "C:\\Users\\x\\AppData\\a.exe"}}),
    ])
    got = {(r.rule_id, r.line_no) for r in rules.event_rule_hits(df).collect()}
    assert ("account-mgmt-system-subject", 1) in got and ("lateral-service-writable-dir", 2) in got


def test_budget_and_rescan(events):
    df = events([("s", i + 1, None, {"method": "TRACE"}) for i in range(6)])
    hits = rules.event_rule_hits(df).cache()
    first = rules.with_outcome(hits, None, 4)
    assert sorted((r.line_no, r.outcome) for r in first.collect()) == [(i, "new" if i <= 4 else "truncated") for i in range(1, 7)]
    stored = hits.filter("line_no in (1, 3, 6)").select(*rules.KEY)
    again = rules.with_outcome(hits, stored, 2)
    assert [(r.line_no, r.outcome) for r in again.orderBy("line_no").collect()] == [
        (1, "dup"), (2, "new"), (3, "dup"), (4, "new"), (5, "truncated"), (6, "truncated")]
    full = rules.with_outcome(hits, hits.select(*rules.KEY), 2)
    assert {r.outcome for r in full.collect()} == {"dup"}


def test_entities(events):
    df = events([
        ("s", 1, None, {"src_ip": "203.0.113.9:80", "user": "Bob", "domain": "WWW.Example.org."}),
        ("s", 2, None, {"local_addr": "[2001:DB8::1]:443", "ip": "0.0.0.0", "remote_addr": "10.0.0.5"}),
        ("s", 3, None, {"account": "x", "data": {"SubjectUserSid": "s-1-5-21-1-2", "TargetUserName": "y"}, "SHA256": "A" * 64}),
        ("s", 4, None, {"src_ip": "203.0.113.9", "domain": "nodot"}),
    ])
    got = {(r.canonical_key, r.raw_value, r.qualifier, r.line_no) for r in entities.entity_table(df).collect()}
    assert got == {
        ("ip:203.0.113.9", "203.0.113.9:80", "global", 1), ("acct:name:bob@h1", "Bob", "host_scoped", 1),
        ("dom:www.example.org", "WWW.Example.org.", "global", 1), ("ip:2001:db8::1", "[2001:DB8::1]:443", "global", 2),
        ("ip:10.0.0.5@h1", "10.0.0.5", "host_scoped", 2), ("acct:sid:S-1-5-21-1-2", "S-1-5-21-1-2", "global", 3),
        ("hash:sha256:" + "a" * 64, "a" * 64, "global", 3),
    }


def test_verdicts_once(spark):
    hits = spark.createDataFrame(
        [(1, "pending", None, None), (2, "accepted", "z", None)], "hit_id int, status string, reviewed_by string, reviewed_at timestamp")
    batch = spark.createDataFrame(
        [(1, "rejected", "a", 0), (1, "accepted", "a", 1), (2, "rejected", "a", 2), (9, "accepted", "a", 3)],
        "hit_id int, verdict string, reviewer string, position int")
    updated, result = review.apply_verdicts(hits, batch)
    assert {(r.hit_id, r.status, r.reviewed_by) for r in updated.collect()} == {(1, "rejected", "a"), (2, "accepted", "z")}
    assert {r.hit_id: r.result for r in result.collect()} == {1: "ok", 2: "conflict", 9: "missing"}


def test_audit_chain(spark):
    import hashlib
    from datetime import datetime

    rows, prev = [], audit.GENESIS
    for i in range(1, 8):
        ts = datetime(2026, 1, 1, 0, 0, i, 120000 if i % 2 else 0)
        text = ts.strftime("%Y-%m-%dT%H:%M:%S") + (".12Z" if i % 2 else "Z")
        parts = [str(i), "c1", text, "amy", "act", "x", "{}", prev]
        digest = hashlib.sha256("\x00".join(parts).encode()).hexdigest()
        rows.append((i, "c1", ts, "amy", "act", "x", "{}", prev, digest))
        prev = digest
    schema = "seq bigint, case_id string, ts timestamp, actor string, action string, scope string, detail_json string, prev_hash string, entry_hash string"
    good = spark.createDataFrame(rows, schema)
    assert audit.verify_chain(good, chunk=3).collect()[0].intact
    tampered = good.withColumn("actor", F.when(F.col("seq") == 5, "eve").otherwise(F.col("actor")))
    r = audit.verify_chain(tampered, chunk=3).collect()[0]
    assert (r.first_break, r.problem) == (5, "content")
    r = audit.verify_chain(good.filter("seq <> 4"), chunk=3).collect()[0]
    assert (r.first_break, r.problem) == (5, "link")


def plain_keywords(text):
    text = text.lower()
    out = set(re.findall("[a-z0-9]{2,}", text))
    for run in re.findall("[\u4e00-\u9fff]+", text):
        out |= {run} if len(run) == 1 else {run[i:i + 2] for i in range(len(run) - 1)}
    return out


def plain_replay(texts, t):
    """(verdict, blocked_by, score) by id, one text after the other."""
    accepted, out = [], {}
    for i, text in texts:
        norm = "".join(ch for ch in text.lower() if ch.isalnum())
        kw = plain_keywords(text)
        same = [k for k, n, _ in accepted if norm and n == norm]
        scores = [(-len(kw & w) / len(kw | w), k) for k, n, w in accepted if norm and kw | w]
        best = min(scores, default=(0.0, None))
        if same:
            out[i] = ("exact", same[0], 1.0)
        elif best[0] <= -t:
            out[i] = ("similar", best[1], -best[0])
        else:
            out[i] = ("none", None, None)
            if norm:
                accepted.append((i, norm, kw))
    return out


def test_duplicate_replay_matches_sequential_rule(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["计划任务", "检查可疑", "排查持久化"]
    texts, base = [], []
    for i in range(250):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(2, 14))]
        base.append(words)
        texts.append((i, rng.choice([" ", "  ", ", "]).join(words)))
    texts += [(250, ""), (251, "!!"), (252, "!!"), (253, "ab c"), (254, "a bc"), (255, "ab c"), (256, "a bc")]
    df = spark.createDataFrame([(None, i, t) for i, t in texts] + [("d", i, t) for i, t in texts[::3]], "case_id string, id bigint, text string")
    thresholds = (0.85, 0.7, 0.5)
    got = {(r.threshold, r.case_id, r.id): (r.verdict, r.blocked_by, r.score) for r in dedup.settled(df, thresholds).collect()}
    want = {(t, c, i): v for t in thresholds for c, rows in ((None, texts), ("d", texts[::3])) for i, v in plain_replay(rows, t).items()}
    assert got == want
    sums = {r.threshold: (r.total, r.exact, r.similar) for r in dedup.threshold_sweep(df, thresholds).collect()}
    for t in thresholds:
        kinds = [v[0] for k, v in want.items() if k[0] == t]
        assert sums[t] == (len(kinds), kinds.count("exact"), kinds.count("similar"))


def test_duplicate_links_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(5000)]
    texts = []
    for i in range(400):
        if i % 3 and texts:
            words = list(rng.choice(texts[-40:])[2])
            for _ in range(rng.choice([0, 1, len(words) // 8, len(words) // 3])):
                words[rng.randrange(len(words))] = rng.choice(rare)
        else:
            size = rng.choice([3, 10, 30, 70, 150, 400])
            words = rng.sample(common, min(size // 2, 60)) + rng.sample(rare, size // 2)
        # a keyword may be the case's name
        texts.append((rng.choice(["es", "fr"]), i, [*words, "es"]))
    df = spark.createDataFrame([(c, i, " ".join(w)) for c, i, w in texts], "case_id string, id bigint, text string")
    sets = [(c, i, "".join(w), set(w)) for c, i, w in texts]
    for t in (0.5, 0.85, 1.0):
        _, reps, rows = dedup._representatives(df)
        got = {(r.case.case_id, r.id, r.other): (r.score, r.exact) for r in dedup.links(reps, rows, t).collect()}
        first = {(r.case.case_id, r.id) for r in reps.collect()}
        want = {}
        for (c, i, a, x), (d, j, b, y) in itertools.product(sets, sets):
            if c == d and j < i and (c, i) in first and (c, j) in first:
                score = len(x & y) / len(x | y)
                if a == b or score >= t:
                    want[c, i, j] = (1.0 if a == b else score, a == b)
        assert got == want and len(want) > (10 if t < 1 else 0)


def test_duplicate_rounds_keep_little_on_disk(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = [(i, " ".join(rng.sample(vocabulary, 300))) for i in range(400)]
    df = spark.createDataFrame([("c", i, t) for i, t in texts], "case_id string, id bigint, text string")
    ensure_checkpoint_dir(spark)
    kept = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(kept.rglob("part-*"))
    assert {r.verdict for r in dedup.settled(df, (0.5,)).collect()} == {"none"}
    written = sum(f.stat().st_size for f in set(kept.rglob("part-*")) - before)
    assert written < 2.5 * sum(len(t) for _, t in texts)


def test_duplicate_replay_without_links(spark):
    df = spark.createDataFrame([("c", 1, "one two"), ("c", 2, "three four"), ("c", 3, None)], "case_id string, id bigint, text string")
    assert [r.verdict for r in dedup.replay(df).collect()] == ["none"] * 3
    assert dedup.replay(df.limit(0)).collect() == []


def test_paths_survive_loops_and_missing_parents(spark):
    rows = [("v", 5, 5, ".", True), ("v", 6, 5, "a", True), ("v", 7, 6, "b", True), ("v", 8, 7, "f.txt", False),
            ("v", 9, 10, "x", True), ("v", 10, 9, "y", True), ("v", 11, 9, "in-loop", False), ("v", 12, 99, "lost", False)]
    rows += [("v", 100 + i, 100 + i - 1 if i else 5, f"d{i}", True) for i in range(70)]
    df = spark.createDataFrame(rows, "volume string, id bigint, parent_id bigint, name string, is_dir boolean")
    got = {r.id: r.path for r in files.file_paths(df).collect()}
    assert got[8] == "a\\b\\f.txt" and got[6] == "a" and got[11] is None and got[12] is None
    assert got[163].count("\\") == 63 and got[169].count("\\") == 69
    assert {r.id: r.path for r in files.file_paths(df, depth=64).collect()}[169] is None


def test_incremental_scan_is_idempotent(spark, events, tmp_path):
    src, hits, ents, ckpt = (str(tmp_path / n) for n in ("events", "hits", "entities", "ckpt"))
    first = events([("s", 1, None, {"method": "TRACE", "src_ip": "203.0.113.4"}), ("s", 2, None, {"ua": "sqlmap"})])
    first.write.parquet(src)

    def run():
        incremental.start(spark.readStream.schema(first.schema).parquet(src), hits, ents, ckpt).awaitTermination()

    run()
    assert spark.read.parquet(hits).count() == 2 and spark.read.parquet(ents).count() == 1
    run()
    assert spark.read.parquet(hits).count() == 2
    # the same event delivered again together with a new one
    events([("s", 1, None, {"method": "TRACE", "src_ip": "203.0.113.4"}), ("s", 3, None, {"method": "PUT", "src_ip": "203.0.113.4"})]).write.mode("append").parquet(src)
    run()
    assert sorted(r.line_no for r in spark.read.parquet(hits).collect()) == [1, 2, 3]
    assert spark.read.parquet(ents).count() == 1
    # a repeated batch leaves the stored rows as they are
    incremental.process_batch(hits, ents)(first, 0)
    assert sorted(r.line_no for r in spark.read.parquet(hits).collect()) == [1, 2, 3]


def test_chain_state_across_batches(spark, events, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    part1 = events([("s", i + 1, f"2026-01-01 00:00:0{i}", {"src_ip": "203.0.113.4", "status": "401"}) for i in range(3)])
    part2 = events([("s", 4, "2026-01-01 00:00:09", {"src_ip": "203.0.113.4", "status": "200"})])
    for part in (part1, part2):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = incremental.streaming_bruteforce_chain(spark.readStream.schema(part1.schema).parquet(src), fail_threshold=3)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.key, r.line_no, r.fail_count, r.fail_first_line, r.fail_nth_line) for r in rows] == [("203.0.113.4", 4, 3, 1, 3)]


def test_pages():
    assert page_range(3, 50) == (101, 150) and page_range(1, 5000) == (1, 5000)
