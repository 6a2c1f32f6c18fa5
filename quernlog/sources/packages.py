"""Collection packages: routing of files, time zone, checksums, and guessing the format of unknown files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlog.data.artifact_map import PACKAGE_HOST, PACKAGE_ROOT, RULES
from quernlog.functions.fields import computed_once

SAMPLE_LINES, HEAD_LINES, HEAD_WEIGHT, AUTO_CONFIDENCE = 200, 20, 2, 0.9


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: '*' and '?' stay within one path segment."""
    return "^" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"


def package_host(root_name: Column) -> Column:
    """Host key in a package folder name, NULL for other folders."""
    return F.when(root_name.rlike(PACKAGE_ROOT), F.regexp_extract(root_name, PACKAGE_HOST, 1))


def route_files(files: DataFrame, path: str = "rel_path", rules: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Artifact, route, parser and log type of each file inside a package; unknown files are kept raw."""
    table = [
        {"pattern": glob_pattern(g), "whole": "/" in g, "artifact": a, "route": r, "parser": p, "log_type": t}
        for g, a, r, p, t in (RULES if rules is None else rules)
    ]
    layout = "array<struct<pattern:string,whole:boolean,artifact:string,route:string,parser:string,log_type:string>>"
    constant = F.from_json(F.lit(json.dumps(table)), layout)
    name = F.substring_index(path, "/", -1)
    # the list is in order, so the first element left is the first rule that matches
    hit = F.get(
        F.filter(constant, lambda r: F.rlike(F.when(r["whole"], F.col(path)).otherwise(name), r["pattern"])), F.lit(0)
    )
    return computed_once(files, {"_hit": hit}).select(
        *files.columns,
        F.coalesce("_hit.artifact", F.lit("unmapped")).alias("artifact_type"),
        F.coalesce("_hit.route", F.lit("raw")).alias("route"),
        F.coalesce("_hit.parser", F.lit("")).alias("parser"),
        F.coalesce("_hit.log_type", F.lit("")).alias("log_type"),
    )


def list_package(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, root folder name, path inside it and size; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_replace("path", "^.*?/" + re.escape(base) + "/", "")
    return listed.select("path", F.lit(base).alias("package"), inside.alias("rel_path"), F.col("length").alias("size_bytes"))


def package_zones(lines: DataFrame, package: str = "package") -> DataFrame:
    """Declared zone per package from the 'Timezone=' line of its collection notes."""
    zone = F.substr("raw", F.lit(len("Timezone=") + 1))
    return (
        lines.filter(F.col("raw").startswith("Timezone="))
        .groupBy(package)
        .agg(F.min_by(F.trim(zone), "line_no").alias("tz"))
    )


def collection_date(lines: DataFrame, package: str = "package") -> DataFrame:
    """Collection start date per package."""
    # Started: yyyy/mm/dd <weekday> hh:mm:ss
    words = F.split(F.ltrim(F.get(F.split("raw", "Started:", 2), F.lit(1))), r"\s+")
    date, clock = F.get(words, F.lit(0)), F.left(F.get(words, F.lit(2)), F.lit(8))

    def form(word: Column) -> Column:
        return F.translate(word, "123456789", "000000000")

    fits = F.coalesce((form(date) == "0000/00/00") & (form(clock) == "00:00:00"), F.lit(False))
    day = F.translate(date, "/", "-").try_cast("date")
    return lines.filter(fits).groupBy(package).agg(F.min_by(day, "line_no").alias("collected"))


# ---- checksums ------------------------------------------------------------------------------------


def manifest_entries(lines: DataFrame, root: str) -> DataFrame:
    """Manifest lines as (rel_path, sha256) plus 'bad' lines that are neither entries nor known headings."""
    text = F.trim(F.col("raw"))
    # 64 hexadecimal digits, then the path; headings are known by how they begin, rulers by their only character
    words = F.split(text, r"\s+", 2)
    digest, path = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    entry = (F.length(digest) == 64) & (F.translate(F.lower(digest), "0123456789abcdef", "") == "") & (path != "")
    heading = F.translate(text, "=", "") == ""
    for begin in ("Host=", "Mode=", "WinInfoSC", "MANIFEST_ROOT_SHA256="):
        heading = heading | text.startswith(begin)
    slashed = F.when(entry, F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))).otherwise("")
    below = F.instr(slashed, f"/{root}/")
    rel = F.when(below > 0, F.substr(slashed, below + F.lit(len(root) + 2))).otherwise("")
    return lines.select(
        F.nullif(rel, F.lit("")).alias("rel_path"),
        F.when(entry, F.lower(digest)).otherwise("").alias("sha256"),
        "line_no",
        F.when(entry, F.when(rel == "", "bad").otherwise("entry"))
        .when(heading, "noise")
        .otherwise("bad")
        .alias("line_kind"),
    )


def reconcile(entries: DataFrame, files: DataFrame) -> DataFrame:
    """State of every path: ok, missing, mismatch or extra.  The last manifest line of a path counts."""
    wanted = entries.filter("line_kind = 'entry'").groupBy("rel_path").agg(F.max_by("sha256", "line_no").alias("want"))
    joined = wanted.join(files.select("rel_path", F.col("sha256").alias("have")), "rel_path", "full_outer")
    state = (
        F.when(F.col("want").isNull(), "extra")
        .when(F.col("have").isNull(), "missing")
        .when(F.col("want") == F.col("have"), "ok")
        .otherwise("mismatch")
    )
    return joined.select("rel_path", state.alias("state"))


def reconcile_summary(states: DataFrame, entries: DataFrame) -> DataFrame:
    bad = entries.filter("line_kind = 'bad'").select(F.count(F.lit(1))).scalar()
    counted = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("ok", "missing", "mismatch", "extra")])
    return counted.select(
        "*", bad.alias("bad_lines"),
        ((F.col("missing") == 0) & (F.col("mismatch") == 0)).alias("passed"),
    )


def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_replace("path", "^.*?/" + re.escape(base) + "/", "")
    return content.select(inside.alias("rel_path"), F.sha2("content", 256).alias("sha256"))


# ---- format guess ---------------------------------------------------------------------------------


def fingerprint(lines: DataFrame, candidates: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Best candidate format per source: share of parsed lines among the first 200, the first 20 counted twice.

    Skipped lines do not count.  Ties go to the candidate listed first; from 0.9 on the format is accepted.
    """
    sample = lines.filter(F.col("line_no") <= SAMPLE_LINES)
    scored = None
    for order, (name, parse) in enumerate(candidates.items()):
        seen = parse(sample).filter("kind <> 'skip'").select("source_id", "line_no", (F.col("kind") == "event").alias("ok"))
        place = F.row_number().over(Window.partitionBy("source_id").orderBy("line_no"))
        weight = F.when(F.col("_place") <= HEAD_LINES, HEAD_WEIGHT).otherwise(1)
        one = (
            seen.withColumn("_place", place)
            .groupBy("source_id")
            .agg(
                (F.sum(F.when(F.col("ok"), weight).otherwise(0)) / F.sum(weight)).alias("confidence"),
                F.count(F.lit(1)).alias("sampled"),
                F.count_if("ok").alias("parsed"),
            )
            .withColumns({"format_id": F.lit(name), "_order": F.lit(-order)})
        )
        scored = one if scored is None else scored.unionByName(one)
    best = scored.groupBy("source_id").agg(
        F.max(F.struct("confidence", "_order", "format_id", "sampled", "parsed")).alias("_best")
    )
    return best.select(
        "source_id", "_best.format_id", "_best.confidence", "_best.sampled", "_best.parsed",
        F.when(F.col("_best.confidence") >= AUTO_CONFIDENCE, "auto").otherwise("pending_confirm").alias("detect_status"),
    )
