"""Decoded file-record tables: full paths and timestamp tampering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlog.session import ensure_checkpoint_dir
from quernlog.sources.file_lists import top_values

TAMPER_SECONDS = 60


def directory_paths(records: DataFrame, depth: int | None = None) -> DataFrame:
    """(volume, id, path) of every directory whose parents lead to the root; the root's path is ''.

    Pointer doubling: each round joins a directory to the ancestor it has reached so far and takes over
    that ancestor's path, so the number of rounds is the logarithm of the deepest nesting.  Missing parents and
    loops are left out: a directory that has moved more steps than there are directories goes in a circle.  With
    ``depth``, deeper directories are left out too.
    """
    ensure_checkpoint_dir(records.sparkSession)
    is_root = F.col("parent_id") == F.col("id")
    state = (
        records.filter("is_dir")
        .select(
            "volume", "id", F.when(is_root, "").otherwise(F.col("name")).alias("path"),
            F.when(~is_root, F.col("parent_id")).alias("_up"), F.when(is_root, 0).otherwise(1).alias("_depth"),
        )
        .checkpoint()
    )
    reach, most = 1, depth if depth is not None else state.count()
    while reach <= 2 * most and not state.filter("_up is not null").isEmpty():
        above = state.select(
            "volume", F.col("id").alias("_up"), F.col("path").alias("_path"), F.col("_up").alias("_next"),
            F.col("_depth").alias("_more"),
        )
        joined = state.join(above, ["volume", "_up"], "left")
        moving, found = F.col("_up").isNotNull(), F.col("_path").isNotNull()
        state = (
            joined.filter(~moving | found)
            .select(
                "volume", "id",
                F.when(moving & (F.col("_path") != ""), F.concat_ws("\\", "_path", "path")).otherwise(F.col("path")).alias("path"),
                F.when(moving, F.col("_next")).alias("_up"),
                (F.col("_depth") + F.when(moving, F.col("_more")).otherwise(0)).alias("_depth"),
            )
            .filter(F.col("_depth") <= most)
            .checkpoint()
        )
        reach *= 2
    return state.filter("_up is null").select("volume", "id", "path")


def file_paths(records: DataFrame, depth: int | None = None) -> DataFrame:
    """Full path of every record, NULL for those whose parent cannot be reached."""
    dirs = directory_paths(records, depth).select("volume", F.col("id").alias("parent_id"), F.col("path").alias("_dir"))
    full = F.when(F.col("_dir") == "", F.col("name")).otherwise(F.concat_ws("\\", "_dir", "name"))
    return records.join(dirs, ["volume", "parent_id"], "left").select(
        *records.columns, F.when(F.col("_dir").isNotNull(), full).alias("path")
    )


def tampered_times(records: DataFrame) -> DataFrame:
    """Records whose name attribute was created over a minute after the standard attribute; no hard links.

    Needs si_created, fn_created, links (names of the record), in_use and path.
    """
    delta = (F.unix_micros("fn_created") - F.unix_micros("si_created")) / 1e6
    return records.withColumn("delta_seconds", delta).filter(
        (F.col("delta_seconds") > TAMPER_SECONDS) & (F.col("links") <= 1)
    )


def tampered_candidates(records: DataFrame, first: int | None = None) -> DataFrame:
    """Such records; with ``first`` so many used and so many deleted ones by number, per volume."""
    if first is None:
        return tampered_times(records)
    ranked = Window.partitionBy("volume", "in_use").orderBy("id")
    return (
        tampered_times(records).withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= first).drop("_rank")
    )


def tampered_directories(records: DataFrame, top: int = 20) -> DataFrame:
    """Directories with the most such records."""
    folder = F.when(F.contains("path", F.lit("\\")), F.regexp_replace("path", r"\\[^\\]*$", "")).otherwise("(root or unresolved)")
    rows = tampered_times(records).select("volume", F.coalesce(folder, F.lit("(root or unresolved)")).alias("dir"))
    return top_values(rows, ["volume"], "dir", top)
