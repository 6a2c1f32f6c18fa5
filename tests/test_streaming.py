"""Carried chain state and the key store against plain rules."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernlog.sources.event_store import EventStore
from quernlog.streaming import incremental
from quernlog.streaming.incremental import NO_TIME, ChainStep


def plain_chain(rows, threshold, window_us, window_lines, latest):
    found, n, first, nth, nth_us, last, last_us = [], 0, 0, 0, None, 0, None
    for line, us, fail in sorted(rows):
        us = None if us == NO_TIME else us
        if fail:
            n += 1
            first = line if n == 1 else first
            if n == threshold:
                nth, nth_us = line, us
            last, last_us = line, us
        elif n >= threshold:
            anchor = last_us if latest else nth_us
            if us is not None and anchor is not None:
                inside = abs(us - anchor) <= window_us
            else:
                inside = latest or line - nth <= window_lines
            if inside:
                found.append((line, us, n, first, nth, last))
                n, last_us, nth_us = 0, None, None
    return found


class Handle:
    """State of one key in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Pieces(self.map)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Pieces:
    def __init__(self, rows):
        self.rows = rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_chain_steps_equal_the_plain_walk(monkeypatch):
    monkeypatch.setattr(incremental, "PIECE", 16)
    r = random.Random(7)
    episodes = 0
    for trial in range(200):
        count = r.choice([0, 1, 5, 60, 300])
        lines = r.sample(range(1, 3 * count + 2), count)
        rows = [(x, NO_TIME if r.random() < 0.1 else 1000 * x + r.randint(-900, 900), int(r.random() < 0.7)) for x in sorted(lines)]
        threshold, window_us, window_lines, latest = r.randint(2, 5), r.choice([3000, 20_000]), r.randint(1, 30), trial % 2 == 0
        step, handle, got = ChainStep(threshold, window_us, window_lines, latest), Handle(), []
        step.init(handle)
        cuts = sorted(r.randint(0, count) for _ in range(r.randint(0, 3)))
        for low, high in zip([0, *cuts], [*cuts, count]):
            batch = rows[low:high]
            r.shuffle(batch)
            size = r.choice([1, 7, 1000])
            frames = [pd.DataFrame(batch[k : k + size], columns=["line_no", "us", "fail"]) for k in range(0, len(batch), size)]
            for out in step.handleInputRows(("c", "s", "k"), iter(frames), None):
                for x in out.itertuples(index=False):
                    us = None if pd.isna(x.ts) else int(x.ts.value // 1000)
                    got.append((x.line_no, us, x.fail_count, x.fail_first_line, x.fail_nth_line, x.fail_last_line))
        assert got == plain_chain(rows, threshold, window_us, window_lines, latest) and not handle.map
        episodes += len(got)
    assert episodes > 200


def test_step_over_a_large_backlog_holds_pieces_only():
    step, handle = ChainStep(3, 10**9, 10, False), Handle()
    step.init(handle)
    n = 100_000
    order = np.random.default_rng(1).permutation(n)
    frames = (pd.DataFrame({"line_no": order[k : k + 5000], "us": order[k : k + 5000] * 10, "fail": (order[k : k + 5000] % 4 != 3)}) for k in range(0, n, 5000))
    found = pd.concat(list(step.handleInputRows(("c", "s", "k"), frames, None)))
    assert len(found) == n // 4 and (found.fail_count == 3).all() and handle.value[0] == 0


def test_store_reads_touched_buckets_only(spark, events, tmp_path):
    hits, ents = str(tmp_path / "h"), str(tmp_path / "e")
    step = incremental.process_batch(hits, ents)
    for k in range(4):
        step(events([(f"s{k}", 1, None, {"method": "TRACE", "src_ip": f"203.0.113.{k}"})]), k)
    stored = spark.read.parquet(hits)
    assert stored.count() == 4 and spark.read.parquet(ents).count() == 4
    some = incremental.stored_rows(spark, hits, stored, [stored.first()["bucket"]])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1].split("]")[0] and 0 < some.count() < 4
    step(events([("s3", 1, None, {"method": "TRACE", "src_ip": "203.0.113.3"}), ("s3", 2, None, {"method": "TRACE"})]), 9)
    assert spark.read.parquet(hits).count() == 5 and spark.read.parquet(ents).count() == 4
    step(events([]), 10)
    assert spark.read.parquet(hits).count() == 5


def test_readers_never_meet_half_of_a_change(spark, events, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = events([(f"s{k}", line, None, {"n": line}) for k in range(6) for line in range(1, 11)]).withColumn("case_id", F.lit("7"))
    store.append(rows.filter("line_no <= 5"))
    store.append(rows.filter("line_no > 5"))
    kept = ["case_id", "source_id", "line_no", "fields"]

    def content():
        return sorted(map(tuple, store.read().select(*kept).collect()))

    before = content()
    assert before == sorted(map(tuple, rows.select(*kept).collect()))
    fresh = rows.filter("source_id = 's2' AND line_no = 3").withColumn("fields", F.lit("{}"))
    want = sorted([x for x in before if x[1] != "s2"] + [("7", "s2", 3, "{}")])

    def fails(*_):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(EventStore, "_commit", fails)
        with pytest.raises(RuntimeError):
            store.replace_sources(fresh)
    assert content() == before
    store.replace_sources(fresh)
    assert content() == want
    store.append(rows.filter("source_id = 's0' AND line_no = 1").withColumn("line_no", F.lit(11).cast("bigint")))
    assert len(content()) == len(want) + 1
