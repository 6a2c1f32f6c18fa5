"""Hash-chained audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.functions.times import rfc3339_nano
from quernlog.operators.chunked import CHUNK, with_prefix

GENESIS = "GENESIS"


def entry_hash() -> Column:
    """Digest over the NUL-joined fields of an entry."""
    return F.sha2(
        F.concat_ws(
            "\u0000",
            *[
                F.coalesce(c, F.lit(""))  # a missing field must not move the others
                for c in (
                    F.col("seq").cast("string"), F.col("case_id"), rfc3339_nano(F.col("ts")), F.col("actor"), F.col("action"),
                    F.col("scope"), F.col("detail_json"), F.col("prev_hash"),
                )
            ],
        ),
        256,
    )


def chain_breaks(audit: DataFrame, chunk: int = CHUNK, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries that break the chain: repeated number, wrong link to the previous entry, changed content.

    A chain is one long sequence, or one per value of ``by``; it is compared in pieces of the sequence number, each
    piece knowing only the last entry before it.
    """
    audit = audit.withColumn("_all", F.lit(1))
    chain = ["_all", *by]
    repeated = audit.groupBy(*chain, "seq").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    linked = with_prefix(audit, chain, "seq", lasts={"_before": F.col("entry_hash")}, size=chunk)
    expected = F.coalesce("_before", F.lit(GENESIS))
    judged = linked.join(repeated, [*chain, "seq"], "left").withColumn("problem", _problem(F.col("_n").isNotNull(), expected))
    return judged.filter(F.col("problem").isNotNull()).select(*by, "seq", "problem")


def _problem(repeated: Column, expected: Column) -> Column:
    return (
        F.when(repeated, "sequence")
        .when(~F.col("prev_hash").eqNullSafe(expected), "link")
        .when(~F.col("entry_hash").eqNullSafe(entry_hash()), "content")
    )


def verify_chain(audit: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row: number of entries, the first broken sequence number and what is wrong there."""
    first = chain_breaks(audit, chunk).agg(
        F.min("seq").alias("first_break"), F.min_by("problem", "seq").alias("problem")
    )
    total = audit.select(F.count(F.lit(1))).scalar()
    return first.select(total.alias("entries"), "first_break", "problem", F.col("first_break").isNull().alias("intact"))


def segment_digests(audit: DataFrame, by: tuple[str, ...] = ("case_id",), size: int = CHUNK) -> DataFrame:
    """One row per segment of ``size`` sequence numbers: what later checks need of it, its entries never again.

    Columns: ``by``, first_seq, last_seq, entries, first_link (the link into the segment), last_hash, and the first
    break inside it.  Digests of appended entries are simply added to the stored ones.
    """
    keys = [*by, "_segment"]
    place = Window.partitionBy(*keys).orderBy("seq", "entry_hash")
    rows = audit.withColumn("_segment", F.floor(F.col("seq") / size)).withColumns(
        {"_at": F.row_number().over(place), "_last_seq": F.lag("seq").over(place), "_last_hash": F.lag("entry_hash").over(place)}
    )
    # the link of a segment's first entry is judged when segments are put together
    expected = F.when(F.col("_at") == 1, F.col("prev_hash")).otherwise(F.col("_last_hash"))
    rows = rows.withColumn("problem", _problem(F.coalesce(F.col("_last_seq") == F.col("seq"), F.lit(False)), expected))
    return rows.groupBy(*keys).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("entries"),
        F.min_by("prev_hash", "_at").alias("first_link"), F.max_by("entry_hash", "_at").alias("last_hash"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("seq", "problem"))).alias("inner"),
    ).select(*by, "first_seq", "last_seq", "entries", "first_link", "last_hash", F.col("inner.seq").alias("first_break"), F.col("inner.problem").alias("problem"))


def verify_segments(segments: DataFrame, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per chain: number of entries, the first break with its problem, and whether the chain is intact.

    Reads digests only, one row per segment and append: a chain that grew is verified by the digests of its new entries.
    """
    order = Window.partitionBy(*by).orderBy("first_seq", "last_seq")
    rows = segments.withColumns({"_seq": F.lag("last_seq").over(order), "_hash": F.lag("last_hash").over(order)})
    border = F.when(F.col("_seq") >= F.col("first_seq"), "sequence").when(
        ~F.col("first_link").eqNullSafe(F.when(F.col("_seq").isNull(), F.lit(GENESIS)).otherwise(F.col("_hash"))), "link"
    )
    rows = rows.withColumn("_border", border).withColumn(
        "_break",
        F.when(F.col("_border").isNotNull(), F.struct(F.col("first_seq").alias("seq"), F.col("_border").alias("problem")))
        .when(F.col("first_break").isNotNull(), F.struct(F.col("first_break").alias("seq"), F.col("problem").alias("problem"))),
    )
    out = rows.groupBy(*by).agg(F.sum("entries").alias("entries"), F.min("_break").alias("_break"))
    return out.select(*by, "entries", F.col("_break.seq").alias("first_break"), F.col("_break.problem").alias("problem"), F.col("_break").isNull().alias("intact"))
