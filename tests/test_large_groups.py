"""Medians and ranks of groups too large to look at whole, lines read back from an index, audit chains by segment."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quernlog.operators import audit, chunked
from quernlog.sources.lines import read_lines, store_lines, stored_range


@pytest.mark.parametrize("settled", [3, 65_536])
def test_median_narrows_down_to_the_middle(spark, monkeypatch, settled):
    monkeypatch.setattr(chunked, "SETTLED", settled)
    monkeypatch.setattr(chunked, "BINS", 8)
    r = random.Random(3)
    groups = {
        "continuous": [r.gauss(1000.0, 1e-9) for _ in range(901)], "even": [r.random() for _ in range(400)], "one": [7.0],
        "equal": [2.5] * 500, "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(333)],
        "zeros": [0.0] * 50 + [-1.0] * 50, "near": [1.0 + k * 2.0**-52 for k in range(301)], "signs": [-3.0, -2.0, 5.0, 9.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.n, x["median"]) for x in chunked.exact_median(df, ["g"], "v").collect()}
    assert got == {g: (len(vs), pytest.approx(statistics.median(vs), rel=1e-15)) for g, vs in groups.items()}


def test_ranges_read_only_their_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, count in (("a.log", 2500), ("b.log", 3), ("c.log", 0)):
        (folder / name).write_text("".join(f"{name} {k + 1}\r\n" if k % 7 == 0 else f"{name} {k + 1}\n" for k in range(count)))
    place = str(tmp_path / "store")
    store_lines(read_lines(spark, str(folder)), place, rows_per_file=200)
    whole = spark.read.parquet(f"{place}/lines")
    source = whole.filter("raw like 'a.log%'").first()["source_id"]
    some = stored_range(spark, place, source, 1190, 1210)
    assert sorted((x.line_no, x.raw) for x in some.collect()) == [(k, f"a.log {k}") for k in range(1190, 1211)]
    assert whole.count() == 2503 and len(whole.inputFiles()) > 10
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan and "GreaterThanOrEqual(line_no,1190)" in plan
    read = some._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions()
    assert read.totalNumberOfFiles() <= 2
    assert stored_range(spark, place, source, 9000, 9001).collect() == [] == stored_range(spark, place, "none", 1, 5).collect()
    assert sorted(x.raw for x in stored_range(spark, place, None, 3, 3).collect()) == ["a.log 3", "b.log 3"]


def test_ranks_over_ranges_equal_a_window(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 30), f"k{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, n int, key string").repartition(5)
    got = {x.key: x.place for x in chunked.ranked(df, ["g"], [F.col("n").desc(), F.col("key")], "place").collect()}
    want = {}
    for g in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        want |= {x[2]: i + 1 for i, x in enumerate(mine)}
    assert got == want and chunked.ranked(df.limit(0), ["g"], [F.col("key")]).collect() == []


def _chain(n, case="c"):
    """Entries of an intact chain as rows of the audit table."""
    out, before = [], audit.GENESIS
    for seq in range(n):
        digest = hashlib.sha256("\0".join([str(seq), case, f"2026-01-01T00:00:{seq % 60:02d}Z", "u", "act", "", "{}", before]).encode()).hexdigest()
        out.append([seq, case, f"2026-01-01 00:00:{seq % 60:02d}", "u", "act", "", "{}", before, digest])
        before = digest
    return out


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_segment_digests_find_the_first_break(spark, size):
    chains, want = {}, {}
    for k, change in enumerate(["none", "content", "link", "repeat", "genesis", "gap", "hash"]):
        case, rows = f"c{k}", _chain(50, f"c{k}")
        at = [None, 20, 21, 14, 0, 28, 35][k]
        if change == "content":
            rows[at][4] = "forged"
        elif change == "link":
            rows[at][7] = "cut"
        elif change == "repeat":
            rows.insert(at, list(rows[at]))
        elif change == "genesis":
            rows[0][7] = "other"
        elif change == "gap":
            del rows[at - 1]
        elif change == "hash":
            rows[at][8] = None
        chains[case] = rows
        want[case] = (len(rows), at, {"content": "content", "hash": "content", "repeat": "sequence", "none": None}.get(change, "link"), at is None)
    schema = "seq long, case_id string, t string, actor string, action string, scope string, detail_json string, prev_hash string, entry_hash string"
    df = spark.createDataFrame([tuple(x) for rows in chains.values() for x in rows], schema).withColumn("ts", F.col("t").cast("timestamp"))
    got = {x.case_id: (x.entries, x.first_break, x.problem, x.intact) for x in audit.verify_segments(audit.segment_digests(df, size=size)).collect()}
    assert got == want
    # entries that come later only add their digests
    parts = audit.segment_digests(df.filter("seq < 23"), size=size).unionByName(audit.segment_digests(df.filter("seq >= 23"), size=size))
    assert {x.case_id: (x.entries, x.first_break, x.problem, x.intact) for x in audit.verify_segments(parts).collect()} == want
    whole = audit.verify_chain(df.filter("case_id = 'c0'")).first()
    assert (whole.entries, whole.intact) == (50, True)
