"""Reading values out of the JSON ``fields`` text as ordinary columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,string>"

# Column names ignore case, JSON keys do not: keys that differ only in case from another one.
_CASE_TWINS = {"SHA256": "upper_sha256"}


def column_name(prefix: str, key: str) -> str:
    """Name of the promoted column of a key; prefix is f, d or x."""
    return f"{prefix}_{_CASE_TWINS.get(key, key)}"


def text_field(key: str, column: str = "fields") -> Column:
    """Top-level value as text; numbers, booleans and nested values in their JSON spelling; '' if absent."""
    return F.coalesce(F.get_json_object(column, f"$['{key}']"), F.lit(""))


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add expensive columns so that each is evaluated once per row.

    A filter on a plain computed column is pushed below the projection together with a copy of its
    expression, and constraints over many such columns multiply while planning; a one-element generator
    keeps the filter above and the expression single.
    """
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return rows.select("*", F.inline(F.array(made)))


def promote(
    events: DataFrame,
    keys: Iterable[str] = (),
    data_keys: Iterable[str] = (),
    extra_keys: Iterable[str] = (),
) -> DataFrame:
    """Add ``f_``/``d_``/``x_`` columns for the wanted keys, parsing the JSON text at most once.

    ``f_k`` is the top-level value, ``d_k`` falls back to the nested ``data`` object and ``x_k`` reads
    the nested ``extras`` object.  Missing values are ''.  Keys that are already columns are kept.
    """
    have = set(events.columns)
    top = [k for k in dict.fromkeys(keys) if column_name("f", k) not in have]
    nested = [k for k in dict.fromkeys(data_keys) if column_name("d", k) not in have]
    extra = [k for k in dict.fromkeys(extra_keys) if column_name("x", k) not in have]
    if not (top or nested or extra):
        return events
    parsed = computed_once(events, {"_top": F.from_json("fields", _MAP)})
    inner = {}
    if nested:
        inner["_data"] = F.from_json(F.try_element_at("_top", F.lit("data")), _MAP)
    if extra:
        inner["_extras"] = F.from_json(F.try_element_at("_top", F.lit("extras")), _MAP)
    if inner:
        parsed = computed_once(parsed, inner)

    def value(source: str, key: str) -> Column:
        return F.coalesce(F.try_element_at(source, F.lit(key)), F.lit(""))

    added = {column_name("f", k): value("_top", k) for k in top}
    added |= {
        column_name("d", k): F.coalesce(F.nullif(value("_top", k), F.lit("")), value("_data", k)) for k in nested
    }
    added |= {column_name("x", k): value("_extras", k) for k in extra}
    return computed_once(parsed, added).drop("_top", "_data", "_extras")


def with_source(events: DataFrame, sources: DataFrame | None, columns: Iterable[str]) -> DataFrame:
    """Attach source attributes; a join only for those the event table lacks.  Events of unregistered sources stay, with NULLs."""
    missing = [c for c in columns if c not in events.columns]
    if not missing:
        return events
    if sources is None:
        raise ValueError(f"event table lacks {missing} and no source table was given")
    return events.join(sources.select("case_id", "source_id", *missing), ["case_id", "source_id"], "left")


def in_domain(log_types: Iterable[str] = (), artifact_kinds: Iterable[str] = ()) -> Column:
    """Whether a source belongs to an operator's domain; no restriction at all means every source."""
    log_types, artifact_kinds = list(log_types), list(artifact_kinds)
    if not log_types and not artifact_kinds:
        return F.lit(True)
    tests = []
    if log_types:
        tests.append(F.coalesce(F.col("log_type").isin(log_types), F.lit(False)))
    if artifact_kinds:
        tests.append(F.coalesce(F.col("artifact_type").isin(artifact_kinds), F.lit(False)))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def domain_columns(log_types: Iterable[str] = (), artifact_kinds: Iterable[str] = ()) -> list[str]:
    return (["log_type"] if list(log_types) else []) + (["artifact_type"] if list(artifact_kinds) else [])


def route(
    events: DataFrame,
    sources: DataFrame | None,
    log_types: Iterable[str] = (),
    artifact_kinds: Iterable[str] = (),
) -> DataFrame:
    """Events of the sources an operator applies to, ``kind='event'`` only."""
    routed = with_source(events, sources, domain_columns(log_types, artifact_kinds))
    return routed.filter((F.col("kind") == "event") & in_domain(log_types, artifact_kinds))


def usable(column: str | Column) -> Column:
    """A key value that may form a group: present and not the '-' placeholder."""
    return F.coalesce(~F.col(column).isin("", "-"), F.lit(False)) if isinstance(column, str) else ~column.isin("", "-")


def key_text(keys: list[str], prefix: str = "f_") -> Column:
    """Bare value for one key field, ``a=x b=y`` for several."""
    if len(keys) == 1:
        return F.col(prefix + keys[0])
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(prefix + k)) for k in keys])


def event_id(column: str = "f_event_id") -> Column:
    return F.col(column).try_cast("bigint")
