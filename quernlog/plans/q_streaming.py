"""Work over a growing event table: the table arrives in slices, results must equal those over the whole of it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.plans.adapters import WEB, duck_cte, web_events
from quernlog.plans.q_detect import _BF_SQL
from quernlog.plans.q_rules import _WEB_HITS
from quernlog.plans.registry import query
from quernlog.session import ensure_checkpoint_dir
from quernlog.sources.event_store import EventStore
from quernlog.streaming import incremental

SLICES = 4


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def feed(events: DataFrame, path: str, after: Callable[[], None]) -> list[DataFrame]:
    """Write the events to ``path`` in slices by line number, ``after`` each of which the stream runs; returns the slices."""
    last = events.agg(F.max("line_no")).first()[0] or 0
    slices = [events.filter(F.ceil(F.col("line_no") * SLICES / max(last, 1)) == k + 1) for k in range(SLICES)]
    for one in slices:
        one.write.mode("append").parquet(path)
        after()
    return slices


@query(
    "stream_bruteforce_chain",
    _BF_SQL[: _BF_SQL.rindex("SELECT source_id, line_no")]
    + "SELECT source_id, line_no, epoch_us(ts) AS ts, key, h_fails AS fail_count, h_first AS fail_first_line, h_nth AS fail_nth_line, "
    "h_last AS fail_last_line FROM walk WHERE hit",
)
def stream_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Failure chains whose counters are carried over slices of the event table."""
    events, place = web_events(spark, sf), _folder(spark)

    def run() -> None:
        found = incremental.streaming_bruteforce_chain(
            spark.readStream.schema(events.schema).parquet(f"{place}/events"), fail_threshold=3, window_seconds=172800, window_lines=500
        )
        writer = found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        writer.trigger(availableNow=True).start().awaitTermination()

    feed(events, f"{place}/events", run)
    rows = spark.read.schema(incremental.CHAIN_OUTPUT).parquet(f"{place}/out")
    return rows.withColumn("ts", F.unix_micros("ts")).drop("case_id")


@query("stream_incremental_scan", f"{_WEB_HITS} SELECT source_id, line_no, rule_id, severity, matched_field, matched_value FROM hits")
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of slices of the event table, the second of them delivered again at the end, as the store holds them."""
    events, place = web_events(spark, sf), _folder(spark)
    source = spark.readStream.schema(events.schema)

    def run() -> None:
        incremental.start(source.parquet(f"{place}/events"), f"{place}/hits", f"{place}/entities", f"{place}/seen").awaitTermination()

    slices = feed(events, f"{place}/events", run)
    slices[1].write.mode("append").parquet(f"{place}/events")
    run()
    return spark.read.parquet(f"{place}/hits").select("source_id", "line_no", "rule_id", "severity", "matched_field", "matched_value")


@query(
    "events_source_renewed",
    f"""WITH {duck_cte(WEB)}, e AS (SELECT source_id, line_no, kind, f_status FROM ev WHERE source_id <> 's1' OR line_no % 3 <> 0)
SELECT source_id, count(*) AS events, CAST(sum(line_no) AS BIGINT) AS lines, count(CASE WHEN f_status = '401' THEN 1 END) AS refused,
 min(line_no) AS first_line, max(line_no) AS last_line FROM e GROUP BY source_id""",
)
def source_renewed(spark: SparkSession, sf: str) -> DataFrame:
    """Stored in two appends, then one source renewed by two thirds of its lines: all other sources stay whole."""
    events = web_events(spark, sf)
    store = EventStore(spark, f"{_folder(spark)}/events")
    store.append(events.filter("line_no % 2 = 0"))
    store.append(events.filter("line_no % 2 = 1"))
    store.replace_sources(events.filter("source_id = 's1' AND line_no % 3 <> 0"))
    return store.read().groupBy("source_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("line_no").alias("lines"), F.count_if(F.col("f_status") == "401").alias("refused"),
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
    )
