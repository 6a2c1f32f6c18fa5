"""Search over the event table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import text_field


@dataclass(frozen=True)
class FieldCondition:
    """``op`` is 'eq' or 'contains'; several values are alternatives; 'raw' names the original text."""

    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class SearchParams:
    """``after`` is the (source_id, line_no) of the last row seen: the next page begins behind it."""

    case_id: str
    text: str = ""
    conditions: tuple[FieldCondition, ...] = ()
    source_ids: tuple[str, ...] = ()
    host: str | None = None
    ts_from: datetime | str | None = None
    ts_to: datetime | str | None = None
    limit: int | None = None
    offset: int = 0
    after: tuple[str, int] | None = None
    kind: str | None = field(default=None)


def contains_ci(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def field_value(events: DataFrame, name: str) -> Column:
    """A promoted column when the table has one, else the value inside the JSON text."""
    if name == "raw":
        return F.col("raw")
    return F.col(f"f_{name}") if f"f_{name}" in events.columns else text_field(name)


def condition(events: DataFrame, cond: FieldCondition) -> Column:
    value = field_value(events, cond.field)
    if cond.op == "eq":
        return value == cond.values[0] if len(cond.values) == 1 else value.isin(*cond.values)
    if cond.op == "contains":
        return reduce(lambda a, b: a | b, [contains_ci(value, v) for v in cond.values])
    raise ValueError(f"unknown operator {cond.op}")


def matching(events: DataFrame, params: SearchParams, sources: DataFrame | None = None) -> DataFrame:
    """All rows that satisfy the search, unordered.  A row without a time never matches a time window."""
    rows = events.filter(F.col("case_id") == params.case_id)
    if params.kind:
        rows = rows.filter(F.col("kind") == params.kind)
    if params.source_ids:
        rows = rows.filter(F.col("source_id").isin(*params.source_ids))
    if params.host is not None:
        if "host" in rows.columns:
            rows = rows.filter(F.col("host") == params.host)
        elif sources is not None:
            wanted = sources.filter(F.col("host") == params.host).select("case_id", "source_id")
            rows = rows.join(wanted, ["case_id", "source_id"], "left_semi")
        else:
            raise ValueError("a host search needs the source table")
    if params.text:
        rows = rows.filter(contains_ci(F.col("raw"), params.text))
    for cond in params.conditions:
        rows = rows.filter(condition(events, cond))
    if params.ts_from is not None:
        rows = rows.filter(F.col("ts") >= F.lit(params.ts_from).cast("timestamp"))
    if params.ts_to is not None:
        rows = rows.filter(F.col("ts") <= F.lit(params.ts_to).cast("timestamp"))
    return rows


def search(events: DataFrame, params: SearchParams, sources: DataFrame | None = None) -> DataFrame:
    """Matches in (source, line) order; a page of them when a limit is given.

    Deep pages are best asked for by ``after``, which is a filter; ``offset`` passes over all rows before.
    """
    page = matching(events, params, sources)
    if params.after is not None:
        source_id, line_no = params.after
        page = page.filter((F.col("source_id") > source_id) | ((F.col("source_id") == source_id) & (F.col("line_no") > line_no)))
    page = page.orderBy("source_id", "line_no")
    if params.offset:
        page = page.offset(params.offset)
    if params.limit is not None:
        page = page.limit(params.limit)
    return page.select("source_id", "line_no", "ts", "kind", "fields", "raw")


def line_range(lines: DataFrame, source_id: str | None, first: int, last: int) -> DataFrame:
    """Original lines ``first`` to ``last`` of a source (or of each source), in order."""
    ranged = lines.filter(F.col("line_no").between(first, last))
    if source_id is not None:
        ranged = ranged.filter(F.col("source_id") == source_id)
    return ranged.orderBy("source_id", "line_no")


def page_range(page: int, size: int) -> tuple[int, int]:
    """Line numbers shown on a page (both counted from 1)."""
    size = max(size, 1)
    first = (max(page, 1) - 1) * size + 1
    return first, first + size - 1
