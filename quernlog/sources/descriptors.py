"""Line parsing driven by a descriptor: regular expression, JSON lines or CSV, and multi-line blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import computed_once
from quernlog.functions.times import parse_time
from quernlog.operators.chunked import CHUNK, follow, with_next, with_prefix
from quernlog.session import materialized
from quernlog.sources.records import groups, is_blank, record

MAP = "map<string,variant>"


def _named_groups(pattern: str) -> tuple[str, dict[str, int], int]:
    """The pattern with plain groups, the group number of every name, and the number of groups."""
    compiled = re.compile(pattern)
    return re.sub(r"\(\?P<\w+>", "(", pattern), dict(compiled.groupindex), compiled.groups


def _regex_fields(lines: DataFrame, desc: dict) -> DataFrame:
    pattern, names, count = _named_groups(desc["line_regex"])
    found = computed_once(lines, {"_g": groups(F.col("raw"), pattern, count)})
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.get("_g", F.lit(i - 1)).alias("v")) for n, i in names.items()])
    # a group without text is left out, except that a pattern's only group may be empty
    kept = pairs if len(names) == 1 else F.filter(pairs, lambda p: p["v"] != "")
    return found.withColumns(
        {
            "_f": F.when(F.col("_g").isNotNull(), F.map_from_entries(kept).cast(MAP)),
            "_why": F.lit("line does not match the pattern"),
        }
    )


def _json_fields(lines: DataFrame, desc: dict) -> DataFrame:
    # a sentinel behind the line shows whether the line is exactly one JSON value
    framed = F.from_json(F.concat(F.lit("["), F.col("raw"), F.lit(',"end"]')), "array<variant>")
    first = F.get("_j", F.lit(0))
    single = F.size("_j") == 2
    is_object = F.startswith(F.schema_of_variant(first), F.lit("OBJECT"))
    return computed_once(lines, {"_j": framed}).withColumns(
        {
            "_f": F.when(single & is_object, F.try_variant_get(first, "$", MAP)),
            "_why": F.when(single, "JSON value is not an object").otherwise("line is not one JSON value"),
        }
    )


def cells(text: Column, delimiter: str) -> Column:
    """Cells of a delimited line; quotes inside a cell are taken as they are."""
    d = re.escape(delimiter)
    quoted = rf'"(?:[^"]|""|"(?!{d}|$))*"'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), text), F.lit(rf"{d}({quoted}|[^{d}]*)"), F.lit(1))
    return F.transform(
        found,
        lambda c: F.when(
            c.rlike(r'(?s)^".*"$') & (F.length(c) > 1),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


def _csv_fields(lines: DataFrame, desc: dict) -> DataFrame:
    delimiter = desc.get("delimiter", ",")
    header = (
        lines.filter(~is_blank(F.col("raw")))
        .groupBy("source_id")
        .agg(F.min_by("raw", "line_no").alias("_head"), F.min("line_no").alias("_head_line"))
    )
    joined = lines.join(header, "source_id", "left")
    parsed = computed_once(
        joined, {"_c": cells(F.col("raw"), delimiter), "_h": cells(F.col("_head"), delimiter)}
    )
    return parsed.withColumns(
        {
            "_f": F.when(F.size("_c") == F.size("_h"), F.map_from_arrays("_h", "_c").cast(MAP)),
            "_why": F.concat(
                F.size("_c").cast("string"), F.lit(" cells, header has "), F.size("_h").cast("string")
            ),
            "_header": F.col("line_no") == F.col("_head_line"),
        }
    )


def _field_text(name: str) -> Column:
    return F.try_variant_get(F.try_element_at("_f", F.lit(name)), "$", "string")


def _normalized(desc: dict, marks: Column | None) -> Column:
    """Mapped fields at the top, everything else under 'extras'."""
    mapped = {k: v for k, v in desc["field_map"].items() if v != "ts_raw"}
    hidden = [k for k, v in desc["field_map"].items() if v == "ts_raw"]
    known = F.array(*[F.lit(k) for k in [*mapped, *hidden]]) if mapped or hidden else F.array().cast("array<string>")
    names = F.create_map(*[F.lit(x) for pair in mapped.items() for x in pair]) if mapped else None
    top = F.map_filter("_f", lambda k, _: F.array_contains(F.array(*[F.lit(k2) for k2 in mapped]), k)) if mapped else F.create_map().cast(MAP)
    if names is not None:
        top = F.transform_keys(top, lambda k, _: F.element_at(names, k))
    rest = F.map_filter("_f", lambda k, _: ~F.array_contains(known, k))
    if marks is not None:
        rest = F.map_concat(rest, marks)
    wrapped = F.create_map(F.lit("extras"), F.to_variant_object(rest))
    return F.when(F.size(F.map_keys(rest)) > 0, F.map_concat(top, wrapped)).otherwise(top)


_FIELDS = {"regex": _regex_fields, "json": _json_fields, "csv": _csv_fields}


def parse_lines(lines: DataFrame, desc: dict) -> DataFrame:
    """Records of one descriptor's lines; with ``start_regex`` continuation lines join their block."""
    if desc.get("start_regex"):
        lines = merge_blocks(lines, desc)
        first = F.substring_index("raw", "\n", 1)
        lines = lines.withColumns({"_whole": F.col("raw"), "raw": first})
    parsed = _FIELDS[desc["kind"]](lines, desc)
    blank = is_blank(F.col("raw"))
    header = F.coalesce(F.col("_header"), F.lit(False)) if desc["kind"] == "csv" else F.lit(False)
    multi = "_whole" in parsed.columns
    orphan_line = F.col("_lost") if multi else F.lit(False)
    formats = desc.get("ts_formats", [])
    stamp = _field_text(desc["ts_field"]) if formats else F.lit(None).cast("string")
    parsed = computed_once(parsed, {"_stamp": stamp, "_local": parse_time(stamp, formats)})
    timeless = F.lit(bool(formats)) & F.col("_local").isNull()
    kind = (
        F.when(blank | header, "skip")
        .when(orphan_line | F.col("_f").isNull() | timeless, "bad")
        .otherwise("event")
    )
    marks = None
    reason = (
        F.when(blank, "blank line").when(header, "CSV header").when(orphan_line, "continuation without an event")
        .when(F.col("_f").isNull(), F.col("_why"))
        .when(F.col("_stamp").isNull(), "time field missing")
        .otherwise("time not readable")
    )
    if multi:
        flags = F.filter(
            F.array(
                F.when(F.col("_truncated"), F.lit("multiline_truncated")),
                F.when(F.col("_orphan"), F.lit("continuation_orphan")),
            ),
            lambda x: x.isNotNull(),
        )
        marks = F.map_from_arrays(flags, F.transform(flags, lambda _: F.lit(True))).cast(MAP)
        reason = F.concat_ws("; ", reason, F.when(F.size(flags) > 0, F.array_join(flags, ", ")))
    out = record(
        parsed, kind, _normalized(desc, marks), reason=reason,
        ts_raw=F.when(F.col("_f").isNotNull(), F.col("_stamp")), dt_local=F.col("_local"),
        continuation_lines=F.col("_parts") - 1 if multi else None,
    ) if not multi else record(
        parsed.withColumn("raw", F.col("_whole")), kind, _normalized(desc, marks), reason=reason,
        ts_raw=F.when(F.col("_f").isNotNull(), F.col("_stamp")), dt_local=F.col("_local"),
        continuation_lines=F.when(kind == "event", F.col("_parts") - 1).otherwise(F.lit(0).cast("bigint")),
    )
    return out


def merge_blocks(lines: DataFrame, desc: dict, chunk: int = CHUNK) -> DataFrame:
    """Continuation lines joined to the line that opens their block; blank lines stay on their own.

    A block is whole unless the descriptor names caps: then it holds at most ``max_continuation_lines`` further
    lines and ``max_block_bytes`` characters, and the line that would exceed either opens an orphan block.  Counters are
    chunked, so one huge source is shared out over many tasks; only the text of a single block is put together in one.
    """
    max_cont, max_chars = desc.get("max_continuation_lines"), desc.get("max_block_bytes")
    start, _, _ = _named_groups(desc["start_regex"])
    start = start if start.startswith("^") else "^(?:" + start + ")"
    blank_lines = lines.filter(is_blank(F.col("raw"))).select("source_id", "line_no", "raw")
    texts = lines.filter(~is_blank(F.col("raw"))).select(
        "source_id", "line_no", F.col("raw").rlike(start).alias("_start"), F.length("raw").cast("bigint").alias("_len")
    )
    # the block structure is worked out without the text and kept; the text joins once at the end
    counted = materialized(
        with_prefix(
            texts, ["source_id"], "line_no",
            sums={"_island": F.col("_start").cast("bigint"), "_row": F.lit(1).cast("bigint"), "_chars": F.col("_len")},
            size=chunk,
        )
    )
    original = lines.select("source_id", "line_no", "raw")
    islands = counted.filter("_island > 0").groupBy("source_id", "_island").agg(
        F.min("_row").alias("_row0"), F.min(F.struct("_row", F.col("_chars") - F.col("_len"))).alias("_c0")
    ).select("source_id", "_island", "_row0", F.col("_c0.col2").alias("_chars0"))
    placed = counted.join(islands, ["source_id", "_island"]).withColumns(
        {"_i": F.col("_row") - F.col("_row0"), "_upto": F.col("_chars") - F.col("_chars0")}
    )
    by_count = placed.withColumn("_part", (F.lit(0) if max_cont is None else F.floor(F.col("_i") / (max_cont + 1))).cast("bigint"))
    pieces = by_count.select("source_id", "line_no", "_island", "_part")
    long_islands = None
    if max_chars is not None:
        sizes = by_count.groupBy("source_id", "_island", "_part").agg(
            F.sum("_len").alias("_size"), F.count(F.lit(1)).alias("_n")
        )
        # an island is cut by line count alone unless some count-sized piece is too long
        long_islands = sizes.filter((F.col("_size") > max_chars) & (F.col("_n") > 1)).select("source_id", "_island").distinct()
    if long_islands is not None and not long_islands.isEmpty():
        pieces = pieces.join(long_islands, ["source_id", "_island"], "left_anti")
        tight = placed.join(long_islands, ["source_id", "_island"], "left_semi")
        cuts = _cuts(tight, max_cont, max_chars, chunk).select("source_id", "_island", F.col("src").alias("_i"))
        flagged = tight.join(cuts.withColumn("_cut", F.lit(1)), ["source_id", "_island", "_i"], "left")
        numbered = with_prefix(
            flagged, ["source_id", "_island"], "_i", sums={"_part": F.coalesce("_cut", F.lit(0)).cast("bigint")}, size=chunk
        )
        pieces = pieces.unionByName(
            numbered.select("source_id", "line_no", "_island", (F.col("_part") - 1).alias("_part"))
        )
    last_part = pieces.groupBy("source_id", "_island").agg(F.max("_part").alias("_last"))
    blocks = (
        pieces.join(original, ["source_id", "line_no"])
        .groupBy("source_id", "_island", "_part")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("_lines"))
        .join(last_part, ["source_id", "_island"])
    )
    merged = blocks.select(
        "source_id",
        F.get("_lines", F.lit(0)).getField("line_no").alias("line_no"),
        F.array_join(F.transform("_lines", lambda x: x["raw"]), "\n").alias("raw"),
        F.size("_lines").cast("bigint").alias("_parts"),
        (F.col("_part") < F.col("_last")).alias("_truncated"),
        (F.col("_part") > 0).alias("_orphan"),
        F.lit(False).alias("_lost"),
    )

    lost = counted.filter("_island = 0").select("source_id", "line_no").join(original, ["source_id", "line_no"])

    def alone(rows: DataFrame, lost: bool) -> DataFrame:
        return rows.select(
            "source_id", "line_no", "raw", F.lit(1).cast("bigint").alias("_parts"), F.lit(False).alias("_truncated"),
            F.lit(False).alias("_orphan"), F.lit(lost).alias("_lost"),
        )

    return merged.unionByName(alone(lost, True)).unionByName(alone(blank_lines, False))


def _cuts(tight: DataFrame, max_cont: int | None, max_chars: int, chunk: int) -> DataFrame:
    """Lines at which the pieces of long islands begin (as edges src -> dst, the first src is 0)."""
    group = ["source_id", "_island"]
    before = F.col("_upto") - F.col("_len")
    marks = tight.select(
        *group, (F.col("_upto") * 2).alias("_pos"), F.col("_i").alias("_node"), F.lit(None).cast("bigint").alias("src")
    ).unionByName(
        tight.select(
            *group, ((before + max_chars) * 2 + 1).alias("_pos"), F.lit(None).cast("bigint").alias("_node"),
            F.col("_i").alias("src"),
        )
    )
    nearest = with_next(marks, group, "_pos", {"_over": F.col("_node")}, size=chunk).filter("src is not null")
    ends = tight.groupBy(*group).agg(F.max("_i").alias("_end"))
    # at least the opening line stays in its own piece, however long it is
    edges = nearest.join(ends, group).select(
        *group, "src",
        F.least(
            F.col("_end") + 1 if max_cont is None else F.col("src") + max_cont + 1,
            F.when(F.col("_over").isNull(), F.col("_end") + 1).otherwise(F.greatest("_over", F.col("src") + 1)),
        ).alias("dst"),
    )
    return follow(edges, group)
