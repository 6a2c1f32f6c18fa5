"""Incremental work over a growing event table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from quernlog.functions.fields import event_id, promote, route, usable
from quernlog.operators import host
from quernlog.operators.entities import entity_table, new_entities
from quernlog.operators.review import findings_to_hits
from quernlog.operators.rules import KEY, event_rule_hits, with_outcome
from quernlog.session import materialized

SEVERITIES = {
    "host-persistence-task": "medium", "host-service-install": "high", "host-process-tree": "medium",
    "host-credential-face": "high",
}
_ROW_DETECTORS = (host.persistence_task, host.service_install, host.process_tree, host.credential_face)
_HIT = [*KEY, "severity", "matched_field", "matched_value", "snippet", "ts", "evidence_grade", "detail"]


def row_candidates(events: DataFrame) -> DataFrame:
    """Candidates that one event decides on its own: signature rules and row-level detectors."""
    out = event_rule_hits(events).withColumn("detail", F.lit("{}")).select(*_HIT)
    for detector in _ROW_DETECTORS:
        out = out.unionByName(findings_to_hits(detector(events), SEVERITIES).select(*_HIT))
    return out


#: Buckets that stored keys are dealt into; a batch reads those its own keys fall into.
BUCKETS = 64


def bucketed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with their bucket: candidates by source, as new lines come from few sources, entities by their key."""
    names = ["case_id", "source_id"] if kind == "hits" else ["case_id", "canonical_key"]
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))


def stored_rows(spark: SparkSession, path: str, like: DataFrame, buckets: list[int]) -> DataFrame:
    """Stored rows of the given buckets, other folders are not read; none before the first write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(like.schema).parquet(path).filter(F.col("bucket").isin(buckets))
    return spark.createDataFrame([], like.schema)


def additions(fresh: DataFrame, stored: DataFrame, kind: str) -> DataFrame:
    """The batch step: rows of a batch that are not stored yet, as a function of both tables alone."""
    if kind == "hits":
        return with_outcome(fresh, stored).filter("outcome = 'new'").drop("outcome")
    return new_entities(fresh, stored)


def process_batch(hits_path: str, entities_path: str) -> Callable[[DataFrame, int], None]:
    """Batch function: append candidates and entities that are not stored yet.

    Every match of a batch is stored: no later round sees its events again.  A batch delivered twice adds nothing: its
    rows carry the batch number, rows with that number from a failed attempt are written over, all others are known by
    key.  Only the buckets of the batch's own keys are read and written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for found, path, kind in ((row_candidates(batch), hits_path, "hits"), (entity_table(batch), entities_path, "entities")):
            fresh = materialized(bucketed(found, kind))
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
            if not touched:
                continue
            stamped = fresh.withColumn("batch", F.lit(batch_id).cast("bigint"))
            stored = stored_rows(spark, path, stamped, touched).filter(F.col("batch") != batch_id)
            (
                bucketed(additions(fresh.drop("bucket"), stored.drop("bucket", "batch"), kind), kind)
                .withColumn("batch", F.lit(batch_id).cast("bigint")).repartition("bucket")
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
            )

    return run


def start(
    events: DataFrame, hits_path: str, entities_path: str, checkpoint: str, *, once: bool = True
) -> StreamingQuery:
    """Run over a streaming event table; the checkpoint remembers which events were seen."""
    writer = events.writeStream.foreachBatch(process_batch(hits_path, entities_path)).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# ---- chains across batches ------------------------------------------------------------------------

CHAIN_OUTPUT = (
    "case_id string, source_id string, key string, line_no bigint, ts timestamp, fail_count bigint, "
    "fail_first_line bigint, fail_nth_line bigint, fail_last_line bigint"
)
CHAIN_STATE = "n bigint, first bigint, nth bigint, nth_us bigint, last bigint, last_us bigint"
#: Lines of a source whose rows of one key are kept together while a backlog is put in order.
PIECE = 4096
#: Stands for a missing time.
NO_TIME = -(1 << 63)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EMPTY = (0, 0, 0, NO_TIME, 0, NO_TIME)


class ChainStep(StatefulProcessor):
    """Failure counters of one key, carried from batch to batch.

    A batch's rows come in slices in any order.  One slice is sorted and walked at once; several go into a map state by
    piece of the line number, and the pieces are walked in order, so no more than a slice and a piece is held.
    """

    def __init__(self, threshold: int, window_us: int, window_lines: int, latest: bool):
        self.threshold, self.window_us, self.window_lines, self.latest = threshold, window_us, window_lines, latest

    def init(self, handle) -> None:
        self.counters = handle.getValueState("counters", CHAIN_STATE)
        self.pieces = handle.getMapState("pieces", "piece bigint", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slices = (np.array([r["line_no"], r["us"], r["fail"]], np.int64) for r in rows if len(r))
        held = next(slices, None)
        if held is None:
            return
        numbers: list[int] = []
        for more in slices:
            if held is not None:
                self._put(held, numbers)
                held = None
            self._put(more, numbers)
        state = tuple(self.counters.get()) if self.counters.exists() else _EMPTY
        for part in [held] if held is not None else self._ordered(numbers):
            state, found = self.walk(part[:, np.argsort(part[0], kind="stable")], state)
            if found:
                yield self._shown(key, found)
        self.counters.update(state)

    def _put(self, rows: np.ndarray, numbers: list[int]) -> None:
        piece = rows[0] // PIECE
        for number in np.unique(piece).tolist():
            before = self.pieces.getValue((number,))[0] if number in numbers else b""
            if not before:
                numbers.append(number)
            self.pieces.updateValue((number,), (before + rows[:, piece == number].T.tobytes(),))

    def _ordered(self, numbers: list[int]) -> Iterator[np.ndarray]:
        for number in sorted(numbers):
            rows = np.frombuffer(self.pieces.getValue((number,))[0], np.int64).reshape(-1, 3).T
            self.pieces.removeKey((number,))
            yield rows

    def walk(self, rows: np.ndarray, state: tuple) -> tuple[tuple, list[tuple]]:
        """State after rows in line order (line, time, failed), and the episodes they close; a step per episode, not per row."""
        lines, us, failed = rows
        fails, others = np.flatnonzero(failed), np.flatnonzero(failed == 0)
        found, position = [], 0
        while True:
            n, first, nth, nth_us, last, last_us = state
            at = int(np.searchsorted(fails, position))
            open_ = fails[at:]
            if n == 0 and len(open_):
                first = int(lines[open_[0]])
            missing = self.threshold - n
            if missing > len(open_):
                if len(open_):
                    last, last_us = int(lines[open_[-1]]), int(us[open_[-1]])
                return (n + len(open_), first, nth, nth_us, last, last_us), found
            begin = position
            if missing > 0:
                k = int(open_[missing - 1])
                begin, nth, nth_us = k + 1, int(lines[k]), int(us[k])
            closing = others[np.searchsorted(others, begin) :]
            before = np.searchsorted(open_, closing)  # failures of this episode ahead of each success
            if self.latest:
                anchor = np.where(before > 0, us[open_[np.maximum(before, 1) - 1]] if len(open_) else last_us, last_us)
            else:
                anchor = np.full(len(closing), nth_us)
            timed = (us[closing] != NO_TIME) & (anchor != NO_TIME)
            untimed = np.ones(len(closing), bool) if self.latest else lines[closing] - nth <= self.window_lines
            gap = np.abs(np.where(timed, us[closing] - np.where(timed, anchor, 0), 0))
            inside = np.where(timed, gap <= self.window_us, untimed)
            if not inside.any():
                if len(open_):
                    last, last_us = int(lines[open_[-1]]), int(us[open_[-1]])
                return (n + len(open_), first, nth, nth_us, last, last_us), found
            hit = int(inside.argmax())
            c, count = int(closing[hit]), int(before[hit])
            if count:
                last = int(lines[open_[count - 1]])
            found.append((int(lines[c]), int(us[c]), n + count, first, nth, last))
            state, position = _EMPTY, c + 1

    def _shown(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in CHAIN_OUTPUT.split(", ")]
        rows = [(*key, line, pd.NaT if us == NO_TIME else pd.Timestamp(us, unit="us"), *rest) for line, us, *rest in found]
        return pd.DataFrame(rows, columns=names)


def _stateful(rows: DataFrame, step: ChainStep) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy("case_id", "source_id", "key").transformWithStateInPandas(step, CHAIN_OUTPUT, "Append", "None")


def _time() -> Column:
    return F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("us")


def streaming_bruteforce_chain(
    events: DataFrame, *, fail_threshold: int = 10, window_seconds: int = 600, window_lines: int = 2000,
    fail_status: tuple[str, ...] = ("401", "403"), success_status: tuple[str, ...] = ("200",),
) -> DataFrame:
    """The web failure chain with its counters carried from batch to batch."""
    web = promote(route(events, None, ("web_access",)), ["src_ip", "status"])
    rows = web.filter((F.col("f_src_ip") != "") & F.col("f_status").isin(*fail_status, *success_status)).select(
        "case_id", "source_id", F.col("f_src_ip").alias("key"), "line_no", _time(),
        F.col("f_status").isin(*fail_status).alias("fail"),
    )
    return _stateful(rows, ChainStep(max(2, fail_threshold), window_seconds * 1_000_000, window_lines, latest=False))


def streaming_auth_chain(
    events: DataFrame, *, fail_event: int = 4625, success_event: int = 4624, fail_threshold: int = 10, window_seconds: int = 600,
) -> DataFrame:
    """The logon failure chain with its counters carried from batch to batch."""
    log = promote(route(events, None, ("windows_event_log",)), ["event_id", "computer"], ["TargetUserName"])
    name = F.col("d_TargetUserName")
    rows = log.filter(
        event_id().isin(fail_event, success_event) & usable("d_TargetUserName") & ~F.endswith(name, F.lit("$"))
    ).select(
        "case_id", "source_id", F.concat_ws("\u001f", "f_computer", name).alias("key"), "line_no",
        _time(), (event_id() == fail_event).alias("fail"),
    )
    return _stateful(rows, ChainStep(max(2, fail_threshold), window_seconds * 1_000_000, 0, latest=True))
