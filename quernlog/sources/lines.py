"""Text files as numbered physical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GBK_NAMES = {"gbk", "gb2312", "gb18030", "cp936"}


def decode_bytes(content: Column, encoding: str = "utf-8") -> Column:
    """Text of raw bytes; undecodable bytes become U+FFFD."""
    if encoding.lower() in GBK_NAMES:
        return F.decode(content, "GB18030" if encoding.lower() == "gb18030" else "GBK")
    return F.make_valid_utf8(content.cast("string"))


def split_lines(documents: DataFrame, source: str, text: str) -> DataFrame:
    """(source_id, line_no, raw) of a column of whole texts; '\\r\\n', '\\n' and '\\r' end a line."""
    parts = F.split(F.col(text), "\r\n|\n|\r", -1)
    # a final line end does not open another line
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return documents.select(
        F.col(source).cast("string").alias("source_id"), F.posexplode(kept).alias("_at", "raw")
    ).select("source_id", (F.col("_at") + 1).cast("bigint").alias("line_no"), "raw")


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """Numbered lines of files of any size; ``source_id`` is the file path.

    Files are read in splits.  Counting lines per split gives every split its first line number, so a
    huge file is numbered by many tasks and no file is held as a whole.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").cast("binary").alias("_bytes"),
    )
    blocks = raw.groupBy("source_id", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        "source_id", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    return raw.join(placed, ["source_id", "_block"]).select(
        "source_id",
        (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("line_no"),
        decode_bytes(F.col("_bytes"), encoding).alias("raw"),
    )


def store_lines(lines: DataFrame, place: str, rows_per_file: int = 1_000_000) -> None:
    """Keep numbered lines (source_id, line_no, raw) for reading ranges: ordered files and a sparse index of them.

    Lines are numbered and counted once, when they are stored.  Files hold consecutive lines, many sources or a part of
    one, as no source is kept together on purpose; the index has one row per file and source with the range of lines.
    """
    ordered = lines.repartitionByRange("source_id", "line_no").sortWithinPartitions("source_id", "line_no")
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{place}/lines")
    spark = lines.sparkSession
    stored = spark.read.schema(lines.schema).parquet(f"{place}/lines")
    index = stored.groupBy(F.col("_metadata.file_path").alias("file"), "source_id").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )
    index.write.parquet(f"{place}/index")


def stored_range(spark: SparkSession, place: str, source_id: str | None, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of a stored source (or of each), from the files the index names; none where it names none.

    Within a file the range is pushed to the scan, so its other row groups are skipped.
    """
    wanted = spark.read.parquet(f"{place}/index").filter((F.col("last_line") >= first) & (F.col("first_line") <= last))
    if source_id is not None:
        wanted = wanted.filter(F.col("source_id") == source_id)
    rows = spark.read.parquet(f"{place}/lines").filter(F.col("line_no").between(first, last))
    if source_id is None:
        return rows
    # the files of one source that meet the range
    files = [r["file"] for r in wanted.select("file").distinct().collect()]
    return rows.filter(F.col("source_id") == source_id).filter(F.col("_metadata.file_path").isin(files)) if files else rows.limit(0)


def sniff_text(content: Column) -> Column:
    """Whether bytes look like text: a BOM, or no NUL and at most 1 % control bytes in the first 8 KB."""
    head = F.substring(content, 1, 8192)
    digits = F.hex(head)
    size = F.length(head)
    pairs = F.regexp_replace(digits, "(..)", "$1 ")
    nul = F.regexp_count(pairs, F.lit(r"\b00 "))
    control = F.regexp_count(pairs, F.lit(r"\b(?:0[1-8BCEF]|1[0-9A-F]) "))
    bom = digits.startswith("EFBBBF") | digits.startswith("FFFE") | digits.startswith("FEFF")
    return bom | ((nul == 0) & ((size == 0) | (control / F.nullif(size, F.lit(0)) <= 0.01)))
