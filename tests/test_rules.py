"""The rule catalogue: every rule has a hit and a near miss; masks agree with a plain reading of the rules."""

import random

from quernlog.data.rules import ALL_RULES, ENTITY_RULES
from quernlog.operators import rules
from quernlog.plans.q_catalogue import CASES


def test_catalogue_names_every_event_rule():
    named = {match[0] for _, _, matches in CASES for match in matches}
    assert named == {r["id"] for r in ALL_RULES if r["target"] == "event"}
    severity = {r["id"]: r["severity"] for r in ALL_RULES}
    assert all(severity[m[0]] == m[1] for _, _, matches in CASES for m in matches)


def _plain(rule, row):
    """Matched field and value of a rule, or None."""
    first = None
    for field, group in rules.by_field_of(rules.conditions(rule)).items():
        text = (row["raw"] if field == "raw" else row.get(field, "")).lower()
        tests = {"contains": lambda n: n in text, "prefix": text.startswith, "endswith": text.endswith, "eq": lambda n: n == text}
        held = [n for c in group for n in c.needles if tests[c.op](n)]
        if not held:
            return None
        first = first or (field, held[0])
    return first


def test_masks_equal_a_plain_reading(events):
    r = random.Random(1)

    def text(n):
        return "".join(r.choice("abAB.*\\' $") for _ in range(n))

    made = []
    for k in range(150):
        match = {}
        for field in r.sample(["one", "two", "raw"], r.randint(1, 3)):
            for suffix in r.sample(["", "_prefix", "_endswith", "_eq"], r.randint(1, 2)):
                needles = [text(r.randint(1, 3)) for _ in range(r.randint(1, 4))]
                match[field + suffix] = needles + [n + text(1) for n in needles[:1]]
        made.append({"id": f"r{k}", "severity": "low", "title": "", "target": "event", "min_hosts": 0, "max_hits": 1, "match": match})
    rows = [{"one": text(r.randint(0, 9)), "two": text(r.randint(0, 3)) + r.choice(["", "\n"])} for _ in range(120)]
    table = events([("s", i, None, row) for i, row in enumerate(rows)])
    raws = {x.line_no: x.raw for x in table.collect()}
    got = sorted((x.line_no, x.rule_id, x.matched_field, x.matched_value) for x in rules.event_rule_hits(table, made).collect())
    want = []
    for i, row in enumerate(rows):
        for rule in made:
            if found := _plain(rule, row | {"raw": raws[i]}):
                want.append((i, rule["id"], *found))
    assert got == sorted(want) and len(want) > 500


def test_entity_rules_hit_and_miss(spark):
    schema = "case_id string, host string, entity_type string, raw_value string, canonical_key string, qualifier string, source_id string, line_no long"
    sid, digest = "S-1-5-21-1-2-3-500", "ab" * 32
    rows = [
        ("h1", "domain", "Up.MEGA.nz", "dom:up.mega.nz", "global"), ("h1", "domain", "mega-nz.example", "dom:mega-nz.example", "global"),
        ("h1", "domain", "eu.NanoPool.org", "dom:eu.nanopool.org", "global"), ("h1", "domain", "carpool-x.org", "dom:carpool-x.org", "global"),
        ("h1", "account", sid, f"acct:sid:{sid}", "global"), ("h2", "account", sid, f"acct:sid:{sid}", "global"),
        ("h1", "account", "bob", "acct:name:bob@h1", "host_scoped"), ("h2", "account", "bob", "acct:name:bob@h1", "host_scoped"),
        ("h1", "file_hash", digest, f"hash:sha256:{digest}", "global"), ("h3", "file_hash", digest, f"hash:sha256:{digest}", "global"),
        ("h1", "file_hash", "cd" * 32, "hash:sha256:" + "cd" * 32, "global"), ("", "file_hash", "cd" * 32, "hash:sha256:" + "cd" * 32, "global"),
        ("h1", "ip", "203.0.113.9", "ip:203.0.113.9", "global"), ("h2", "ip", "203.0.113.9", "ip:203.0.113.9", "global"),
        ("h1", "ip", "203.0.113.8", "ip:203.0.113.8", "global"), ("h1", "ip", "203.0.113.8", "ip:203.0.113.8", "global"),
    ]
    table = spark.createDataFrame([("c1", *row, "s1", i) for i, row in enumerate(rows)], schema)
    got = sorted((x.rule_id, x.severity, x.matched_value, x.line_no) for x in rules.entity_rule_hits(table).collect())
    assert got == [
        ("exfil-cloud-storage-domain", "medium", "domain", 0), ("miner-pool-domain-entity", "medium", "domain", 2),
        ("xhost-shared-account-sid", "medium", f"acct:sid:{sid}", 4), ("xhost-shared-file-hash", "high", f"hash:sha256:{digest}", 8),
        ("xhost-shared-public-ip", "medium", "ip:203.0.113.9", 12),
    ]
    assert {x[0] for x in got} == {r["id"] for r in ENTITY_RULES}
