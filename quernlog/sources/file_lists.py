"""File change journals and file lists exported as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.functions.fields import computed_once
from quernlog.functions.times import filetime
from quernlog.operators.chunked import ranked
from quernlog.sources.descriptors import cells
from quernlog.sources.records import is_blank, record

# Change reason bits.
REASONS = {
    0x00000001: "DATA_OVERWRITE", 0x00000002: "DATA_EXTEND", 0x00000004: "DATA_TRUNCATION",
    0x00000010: "NAMED_DATA_OVERWRITE", 0x00000020: "NAMED_DATA_EXTEND", 0x00000040: "NAMED_DATA_TRUNCATION",
    0x00000100: "FILE_CREATE", 0x00000200: "FILE_DELETE", 0x00000400: "EA_CHANGE", 0x00000800: "SECURITY_CHANGE",
    0x00001000: "RENAME_OLD_NAME", 0x00002000: "RENAME_NEW_NAME", 0x00004000: "INDEXABLE_CHANGE",
    0x00008000: "BASIC_INFO_CHANGE", 0x00010000: "HARD_LINK_CHANGE", 0x00020000: "COMPRESSION_CHANGE",
    0x00040000: "ENCRYPTION_CHANGE", 0x00080000: "OBJECT_ID_CHANGE", 0x00100000: "REPARSE_POINT_CHANGE",
    0x00200000: "STREAM_CHANGE", 0x80000000: "CLOSE",
}


def reason_names(code: Column) -> Column:
    """Names of the set bits; bits without a name are listed together."""
    known = sum(REASONS)
    unknown = code.bitwiseAND(~known & 0xFFFFFFFF)
    named = [F.when(code.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in REASONS.items()]
    rest = F.when(unknown != 0, F.concat(F.lit("UNKNOWN_0x"), F.lpad(F.hex(unknown), 8, "0")))
    return F.array_compact(F.array(*named, rest))


def parse_usn(lines: DataFrame) -> DataFrame:
    """Change journal CSV: lines after the header whose anchor columns have the known shape."""
    rows = computed_once(lines, {"_c": cells(F.col("raw"), ",")})

    def cell(i: int) -> Column:
        return F.get("_c", F.lit(i))

    head = F.lower(F.trim(cell(0))) == "usn"
    first = rows.filter(head).groupBy("source_id").agg(F.min("line_no").alias("_head"))
    rows = rows.join(first, "source_id", "left")
    before = F.col("_head").isNull() | (F.col("line_no") <= F.col("_head"))
    reason = F.lower(F.trim(cell(3)))
    usn = F.trim(cell(0))
    good = (F.size("_c") >= 16) & usn.rlike(r"^\d+$") & reason.rlike("^0x[0-9a-f]{8}$") & (cell(1) != "")
    code = F.conv(F.substring(reason, 3, 8), 16, 10).cast("bigint")
    text = F.trim(cell(5))
    stamp = F.coalesce(
        F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2} "), F.try_to_timestamp(text, F.lit("yyyy/M/d H:m:s"))),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} "), F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s"))),
    )
    norm = {
        "event_type": F.lit("usn_change"), "usn": usn.try_cast("bigint"), "path": cell(1), "filename": cell(1),
        "reason_hex": reason, "reason_flags": reason_names(code), "reason_text": cell(4),
        "file_id": F.trim(cell(8)), "parent_file_id": F.trim(cell(9)), "filename_length": cell(2).try_cast("bigint"),
        "file_attributes_hex": F.trim(cell(6)), "file_attributes_text": cell(7), "security_id": cell(12).try_cast("bigint"),
        "major_version": cell(13).try_cast("bigint"), "minor_version": cell(14).try_cast("bigint"),
        "record_length": cell(15).try_cast("bigint"),
    }
    kind = F.when(is_blank(F.col("raw")) | before, "skip").when(good, "event").otherwise("bad")
    why = F.when(before, "preamble or header").when(F.size("_c") < 16, "too few columns").otherwise("anchor column differs")
    return record(rows, kind, norm, reason=why, ts_raw=F.nullif(text, F.lit("")), dt_local=stamp)


def usn_summary(records: DataFrame) -> DataFrame:
    """Per source: row counts, first and last number in line order, creations, deletions, renames."""
    event = F.col("kind") == "event"
    flags = F.col("norm.reason_flags")
    line = F.when(event, F.col("line_no"))
    return records.filter("kind <> 'skip'").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(event).alias("valid_rows"), F.count_if(~event).alias("bad_rows"),
        F.min_by("norm.usn", line).alias("first_usn"), F.max_by("norm.usn", line).alias("last_usn"),
        *[
            F.count_if(event & F.array_contains(flags, name)).alias(alias)
            for name, alias in (
                ("FILE_CREATE", "file_creates"), ("FILE_DELETE", "file_deletes"), ("RENAME_OLD_NAME", "rename_old"),
                ("RENAME_NEW_NAME", "rename_new"),
            )
        ],
        F.count_if(event & F.col("dt_local").isNull() & F.col("ts_raw").isNotNull()).alias("rows_ts_unresolved"),
    )


def top_values(rows: DataFrame, group: list[str], key: str, top: int | None) -> DataFrame:
    """The most frequent keys per group with their rank, ties by key; all of them without ``top``."""
    counted = rows.groupBy(*group, key).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col(key)]
    if top is None:
        return ranked(counted, group, order)
    # only the first rows of each task's part of a group reach the window
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= top)


def usn_reason_histogram(records: DataFrame, top: int | None = None) -> DataFrame:
    named = records.filter("kind = 'event'").select("source_id", F.explode("norm.reason_flags").alias("reason"))
    return top_values(named, ["source_id"], "reason", top)


def usn_top_files(records: DataFrame, top: int | None = None) -> DataFrame:
    files = records.filter("kind = 'event'").select("source_id", F.col("norm.filename").alias("file"))
    return top_values(files, ["source_id"], "file", top)


def parse_file_list(lines: DataFrame) -> DataFrame:
    """File list CSV with columns Filename, Size, Date Modified, Date Created, Attributes in any order."""
    rows = computed_once(lines, {"_c": cells(F.col("raw"), ",")})
    head = (
        rows.filter(~is_blank(F.col("raw"))).groupBy("source_id")
        .agg(F.min(F.struct("line_no", "_c")).alias("_h")).select("source_id", F.col("_h.line_no").alias("_head"), F.col("_h._c").alias("_names"))
    )
    names = F.transform("_names", lambda n: F.lower(F.trim(F.regexp_replace(n, "^﻿", ""))))
    rows = rows.join(head.withColumn("_names", names), "source_id", "left")  # a source of blank lines has no header

    def cell(name: str) -> Column:
        at = F.array_position("_names", name)
        return F.when(at > 0, F.trim(F.get("_c", (at - 1).cast("int"))))

    path = F.coalesce(cell("filename"), F.lit(""))
    rows = computed_once(
        rows,
        {
            "_path": path, "_size": cell("size"), "_attr": cell("attributes"),
            "_mod": filetime(cell("date modified").try_cast("bigint")), "_made": filetime(cell("date created").try_cast("bigint")),
        },
    )
    base = F.regexp_extract("_path", r"([^\\/]*)$", 1)
    ext = F.lower(F.nullif(F.regexp_extract(base, r"^.+\.([^.]+)$", 1), F.lit("")))
    shape = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    norm = {
        "event_type": F.lit("file_listing_entry"), "path": F.col("_path"),
        "filename": F.when(base == "", F.col("_path")).otherwise(base), "extension": ext,
        "size_bytes": F.when(F.col("_size").rlike(r"^-?\d+$"), F.col("_size").try_cast("bigint")),
        "attributes": F.nullif("_attr", F.lit("")), "date_modified_utc": F.date_format("_mod", shape),
        "date_created_utc": F.date_format("_made", shape),
        "drive": F.when(F.contains(F.left("_path", F.lit(3)), F.lit(":")), F.upper(F.substring_index("_path", ":", 1))),
        "ragged": F.size("_c") != F.size("_names"),
    }
    header = F.coalesce(F.col("line_no") <= F.col("_head"), F.lit(False))
    kind = F.when(is_blank(F.col("raw")) | header, "skip").when(F.col("_path") == "", "bad").otherwise("event")
    return record(rows, kind, norm, reason=F.when(header, "header").otherwise("no path"), ts_direct=F.col("_mod"))


def file_list_summary(records: DataFrame) -> DataFrame:
    rows = records.filter("kind <> 'skip'")
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if((F.col("kind") == "bad") | F.col("norm.ragged")).alias("bad_rows"),
        F.count_distinct("norm.extension").alias("distinct_extensions"),
    )


def file_list_extensions(records: DataFrame, top: int | None = None) -> DataFrame:
    rows = records.filter("kind = 'event'").select("source_id", F.coalesce("norm.extension", F.lit("(none)")).alias("extension"))
    return top_values(rows, ["source_id"], "extension", top)


def file_list_drives(records: DataFrame) -> DataFrame:
    rows = records.filter("kind = 'event'").select("source_id", F.coalesce("norm.drive", F.lit("(none)")).alias("drive"))
    return rows.groupBy("source_id", "drive").agg(F.count(F.lit(1)).alias("count"))
