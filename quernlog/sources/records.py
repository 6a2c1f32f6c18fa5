"""Parsed-line records and their way into the event table.

Every parser is a function from numbered lines to records:
``source_id, line_no, raw, kind, reason, ts_raw, dt_local, ts_direct, continuation_lines, norm`` where
``norm`` is a struct or map of normalized fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.functions.fields import computed_once
from quernlog.functions.times import to_utc
from quernlog.session import materialized

SEPARATOR = "\u0001"


def groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a whole-text match as an array (one regex evaluation), NULL without a match.

    A group that took no part is ''.
    """
    body = pattern if pattern.endswith("$") else pattern + r"[\s\S]*$"
    target = SEPARATOR.join([""] + [f"${i}" for i in range(1, count + 1)])
    parts = F.split(F.regexp_replace(text, body, target), SEPARATOR, -1)
    return F.when((F.size(parts) == count + 1) & ~text.contains(SEPARATOR), F.slice(parts, 2, count))


def matched(lines: DataFrame, **patterns: tuple[str, int]) -> DataFrame:
    """Add one array column per named pattern, each evaluated once per row."""
    return computed_once(lines, {n: groups(F.col("raw"), p, c) for n, (p, c) in patterns.items()})


def group(column: str, i: int) -> Column:
    """i-th group (from 1), NULL when empty or unmatched."""
    return F.nullif(F.get(F.col(column), F.lit(i - 1)), F.lit(""))


def is_blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


def record(
    lines: DataFrame,
    kind: Column,
    norm: dict[str, Column] | Column,
    *,
    reason: Column | None = None,
    ts_raw: Column | None = None,
    dt_local: Column | None = None,
    ts_direct: Column | None = None,
    continuation_lines: Column | None = None,
) -> DataFrame:
    """Project onto the record columns; time and fields only count for events."""
    null_text, null_ts = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    fields = norm if isinstance(norm, Column) else F.struct(*[v.alias(k) for k, v in norm.items()])
    typed = lines.withColumn("_kind", kind)
    event = F.col("_kind") == "event"
    return typed.select(
        "source_id",
        "line_no",
        "raw",
        F.col("_kind").alias("kind"),
        F.when(~event, reason if reason is not None else null_text).alias("reason"),
        (ts_raw if ts_raw is not None else null_text).alias("ts_raw"),
        F.when(event, dt_local if dt_local is not None else null_ts).alias("dt_local"),
        F.when(event, ts_direct if ts_direct is not None else null_ts).alias("ts_direct"),
        (continuation_lines if continuation_lines is not None else F.lit(0).cast("bigint")).alias("continuation_lines"),
        F.when(event, fields).alias("norm"),
    )


def to_events(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Event rows: a direct UTC stamp wins, then local time in the declared zone, else no time.

    ``sources`` carries case_id, source_id, tz (declared zone), log_type, artifact_type, host.  Records that
    carry a case_id belong to it; else a source id stands for one case.  Lines of unregistered sources stay, with
    NULL attributes and no local time.  Stored stamps have millisecond precision.
    """
    key = ["case_id", "source_id"] if "case_id" in records.columns else ["source_id"]
    joined = records.join(sources.select("case_id", "source_id", "tz", "log_type", "artifact_type", "host"), key, "left")
    ts = F.coalesce("ts_direct", to_utc(F.col("dt_local"), F.col("tz")))
    return joined.select(
        "case_id", "source_id", "line_no", F.date_trunc("MILLISECOND", ts).alias("ts"), "kind",
        F.coalesce(F.to_json("norm"), F.lit("{}")).alias("fields"), "raw", "log_type", "artifact_type", "host",
    )


#: Folders of a case in the stored event table; a source lies in one of them.
SOURCE_BUCKETS = 64


def with_bucket(events: DataFrame) -> DataFrame:
    """The stored table's folder of each row, from its source."""
    return events.withColumn("source_bucket", F.pmod(F.xxhash64("source_id"), F.lit(SOURCE_BUCKETS)).cast("int"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Store events in folders by case and bucket of the source, ordered by source and line within files.

    Rows are dealt out by folder and piece of the lines, so a large source is written by many tasks and a task writes
    few files.  With mode 'overwrite' the folders present in ``events`` are replaced as a whole: use
    :func:`replace_source` to renew single sources.
    """
    piece = F.floor(F.col("line_no") / 4_000_000)
    (
        with_bucket(events)
        .repartition("case_id", "source_bucket", piece)
        .sortWithinPartitions("case_id", "source_bucket", "source_id", "line_no")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("case_id", "source_bucket")
        .parquet(path)
    )


def replaced(events: DataFrame, fresh: DataFrame) -> DataFrame:
    """Event rows after re-parsing: old rows of the sources in ``fresh`` are dropped and the fresh ones added.

    A source of which nothing is left must be among the sources of ``fresh`` with one row at least.
    """
    renewed = fresh.select("case_id", "source_id").distinct()
    return events.join(renewed, ["case_id", "source_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_source(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Renew the sources in ``fresh`` in a stored table; only the folders they lie in are read and written.

    The renewed folders are kept in the checkpoint folder before the old ones are written over, so an interrupted run
    can be repeated.
    """
    touched = with_bucket(fresh).select("case_id", "source_bucket").distinct()
    old = spark.read.parquet(path).join(touched, ["case_id", "source_bucket"], "left_semi").drop("source_bucket")
    write_events(materialized(replaced(old, fresh)), path, "overwrite")


def canonical_records(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One canonical JSON text per record, for line-oriented export."""
    ts = F.coalesce("ts_direct", to_utc(F.col("dt_local"), F.col("tz")))
    micros = F.date_format(ts, "SSSSSS")
    text = F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
        F.lit("Z"),
    )
    key = ["case_id", "source_id"] if "case_id" in records.columns else ["source_id"]
    joined = records.join(sources.select(*key, "tz"), key, "left")
    return joined.select(
        "source_id", "line_no",
        F.to_json(
            F.struct("line_no", "kind", "ts_raw", text.alias("ts_utc"), "norm", "raw", "reason", "continuation_lines")
        ).alias("record"),
    )
