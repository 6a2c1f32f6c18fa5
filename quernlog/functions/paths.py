"""File path text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Trimmed of blanks and quotes, slashes as backslashes, lower case."""
    unquoted = F.regexp_replace(F.trim(path), "^[\"']+|[\"']+$", "")
    return F.lower(F.replace(unquoted, F.lit("/"), F.lit("\\")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot, NULL without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))
