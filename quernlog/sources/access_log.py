"""Combined-format access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlog.sources.records import group, groups, is_blank, matched, record

COMBINED = (
    r'^([^\s]+) [^\s]+ ([^\s]+) \[([^\]]*)\] "([^"]*)" (\d{3}) ([^\s]+) "([^"]*)" "([^"]*)"(.*)$'
)
REQUEST = r"^(\S+) ([^ ]+)(?: ([^ ]+))?$"
STAMP = r"^(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}) ([+-]\d{4})$"
XFF = r'^"\s*(\d{1,3}(?:\.\d{1,3}){3}(?:\s*,\s*\d{1,3}(?:\.\d{1,3}){3})*)\s*"$'


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Records of combined-format lines; local time is the wall clock, the offset is kept as evidence."""
    parsed = matched(lines, _m=(COMBINED, 9)).withColumns(
        {"_request": group("_m", 4), "_stamp": group("_m", 3), "_rest": F.trim(F.get("_m", F.lit(8)))}
    )
    parsed = parsed.withColumns(
        {
            "_r": groups(F.col("_request"), REQUEST, 3),
            "_local": F.when(
                F.col("_stamp").rlike(STAMP),
                F.try_to_timestamp(F.regexp_extract("_stamp", STAMP, 1), F.lit("dd/MMM/yyyy:HH:mm:ss")),
            ),
            "_xff": F.nullif(F.regexp_extract("_rest", XFF, 1), F.lit("")),
        }
    )

    def shown(i: int):  # noqa: ANN202
        return F.nullif(group("_m", i), F.lit("-"))

    target = group("_r", 2)
    has_query = F.contains(target, F.lit("?"))
    extras = F.struct(
        F.regexp_extract("_stamp", STAMP, 2).alias("time_offset"),
        group("_r", 3).alias("protocol"),
        F.when(F.col("_r").isNull(), F.col("_request")).alias("request"),
        F.when(F.col("_xff").isNull(), F.nullif("_rest", F.lit(""))).alias("trailing"),
    )
    kind = (
        F.when(is_blank(F.col("raw")), "skip")
        .when(F.col("_m").isNull() | F.col("_local").isNull(), "bad")
        .otherwise("event")
    )
    return record(
        parsed,
        kind,
        {
            "src_ip": group("_m", 1),
            "user": shown(2),
            "method": group("_r", 1),
            "path": F.substring_index(target, "?", 1),
            "query": F.when(has_query, F.regexp_replace(target, r"^[^?]*\?", "")),
            "status": group("_m", 5).cast("int"),
            "bytes": F.when(group("_m", 6).rlike(r"^\d+$"), group("_m", 6).try_cast("bigint")),
            "referer": shown(7),
            "ua": shown(8),
            "xff": F.col("_xff"),
            "extras": extras,
        },
        reason=F.when(is_blank(F.col("raw")), "blank line")
        .when(F.col("_m").isNull(), "not a combined-format line")
        .otherwise("time not readable"),
        ts_raw=F.col("_stamp"),
        dt_local=F.col("_local"),
    )
