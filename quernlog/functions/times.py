"""Time text, declared zones and time arithmetic."""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard offsets used when a name is not in the zone database.
STANDARD_OFFSETS = {
    "asia/shanghai": "+08:00", "asia/beijing": "+08:00", "asia/chongqing": "+08:00", "asia/hong_kong": "+08:00",
    "asia/taipei": "+08:00", "asia/singapore": "+08:00", "asia/tokyo": "+09:00", "asia/seoul": "+09:00",
    "asia/kolkata": "+05:30", "europe/london": "+00:00", "europe/paris": "+01:00", "europe/berlin": "+01:00",
    "america/new_york": "-05:00", "america/chicago": "-06:00", "america/los_angeles": "-08:00",
    "utc": "+00:00", "etc/utc": "+00:00", "etc/gmt": "+00:00",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# strptime directive: (pattern letters, regular expression)
_DIRECTIVES = {
    "Y": ("yyyy", r"\d{4}"), "m": ("M", r"\d{1,2}"), "d": ("d", r"\d{1,2}"), "H": ("H", r"\d{1,2}"),
    "M": ("m", r"\d{1,2}"), "S": ("s", r"\d{1,2}"), "f": ("SSSSSS", r"\d{1,6}"), "b": ("MMM", "[A-Za-z]{3}"),
    "B": ("MMMM", "[A-Za-z]+"), "y": ("yy", r"\d{2}"), "I": ("h", r"\d{1,2}"), "p": ("a", "[AaPp][Mm]"),
    "z": ("xx", r"[+-]\d{4}"),
}


def _translate(fmt: str) -> tuple[str, str]:
    pattern, regex, i = "", "", 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            letters, body = _DIRECTIVES[fmt[i + 1]]
            pattern, regex, i = pattern + letters, regex + body, i + 2
            continue
        pattern += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
        regex += re.escape(c)
        i += 1
    return pattern, regex


def parse_time(text: Column, formats: list[str]) -> Column:
    """First strptime format that fits the whole text; without a year the year is 1900."""
    tries = []
    for fmt in formats:
        pattern, regex = _translate(fmt)
        value = text
        if "%Y" not in fmt and "%y" not in fmt:
            pattern, value = "yyyy " + pattern, F.concat(F.lit("1900 "), text)
        tries.append(F.when(text.rlike(f"^(?:{regex})$"), F.try_to_timestamp(value, F.lit(pattern))))
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp")


def resolve_zone(declared: Column) -> Column:
    """Usable zone name or offset of a declared zone, NULL when it is unknown."""
    name = F.trim(declared)
    literal = r"(?i)^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    offset = F.concat(
        F.regexp_extract(name, literal, 1),
        F.lpad(F.regexp_extract(name, literal, 2), 2, "0"),
        F.lit(":"),
        F.coalesce(F.nullif(F.regexp_extract(name, literal, 3), F.lit("")), F.lit("00")),
    )
    fixed = F.lit(None).cast("string")
    for zone, value in STANDARD_OFFSETS.items():
        fixed = F.when(F.lower(name) == zone, value).otherwise(fixed)
    return (
        F.when(name.isin(sorted(zoneinfo.available_timezones())), name)
        .when(fixed.isNotNull(), fixed)
        .when(name.rlike(literal), offset)
    )


def to_utc(local: Column, declared: Column) -> Column:
    """Wall-clock time in a declared zone as UTC; NULL when the zone is unknown."""
    zone = resolve_zone(declared)
    return F.when(zone.isNotNull(), F.to_utc_timestamp(local, zone))


def infer_year(month: Column, day: Column, collected: Column) -> Column:
    """Year of a year-less stamp: a month and day after the collection date belong to the year before."""
    later = (month > F.month(collected)) | ((month == F.month(collected)) & (day > F.dayofmonth(collected)))
    return F.struct(
        (F.year(collected) - F.when(later, 1).otherwise(0)).alias("year"), later.alias("rollover")
    )


def month_number(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))
    return F.when(position > 0, position.cast("int"))


def filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 as an instant; NULL for zero, negative or absurd values."""
    delta = 116_444_736_000_000_000
    valid = (ticks >= delta) & (ticks - delta <= 2_534_023_007_990_000_000)
    return F.when(valid, F.timestamp_micros(F.floor((ticks - delta) / 10).cast("bigint")))


def rfc3339_nano(ts: Column) -> Column:
    """UTC text with trailing zeros of the fraction removed."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))
