"""Shape shared by all detector results, evidence grades and the mapping onto candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON = [
    "op_id", "case_id", "source_id", "line_no", "ts", "matched_field", "matched_value", "snippet",
    "independent_points", "chain_linked", "statistical_only", "evidence_grade",
]
SNIPPET_CHARS = 240

# What a reader must rule out before trusting a purely statistical finding.
EXCLUSIONS = {
    "web-beacon-periodicity": [
        "automated probes of CDNs, monitors and load balancers",
        "normal polling against the business baseline",
    ],
    "web-ip-rate-spike": [
        "release, campaign or backup peaks",
        "a NAT or proxy exit that adds up many clients",
    ],
    "web-key-divergence": [
        "bodies that differ by design between the compared values",
        "small error bodies next to full pages; shared exits and crawler pools",
    ],
    "web-outlier": [
        "download and upload endpoints that are large by design",
        "error pages and redirects that are small by design",
    ],
    "host-time-cluster": [
        "builds, sync clients and backup windows",
        "system updates and index rebuilds",
    ],
}


def grade(points: Column, linked: Column, statistical: Column) -> Column:
    """weak: statistics only; strong: two or more independent points that are linked; else suspect."""
    return (
        F.when(statistical, "weak").when((points >= 2) & linked, "strong").otherwise("suspect")
    )


def finding(
    rows: DataFrame,
    op_id: str,
    matched_field: str | Column,
    matched_value: Column,
    detail: dict[str, Column],
    *,
    points: int | Column = 0,
    linked: bool | Column = False,
    statistical: bool = False,
    snippet: Column | None = None,
    ts: Column | None = None,
) -> DataFrame:
    """Project detector rows onto the common columns followed by the detector's own typed columns."""
    if statistical and not EXCLUSIONS.get(op_id):
        raise ValueError(f"{op_id}: a statistical finding must name what has to be ruled out")

    def column(value: object) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    point_col, link_col, stat_col = column(points).cast("int"), column(linked), F.lit(statistical)
    return rows.select(
        F.lit(op_id).alias("op_id"),
        "case_id",
        "source_id",
        "line_no",
        (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"),
        column(matched_field).alias("matched_field"),
        matched_value.cast("string").alias("matched_value"),
        F.left(F.coalesce(snippet, F.lit("")) if snippet is not None else F.lit(""), F.lit(SNIPPET_CHARS)).alias("snippet"),
        point_col.alias("independent_points"),
        link_col.alias("chain_linked"),
        stat_col.alias("statistical_only"),
        grade(point_col, link_col, stat_col).alias("evidence_grade"),
        *[v.alias(k) for k, v in detail.items()],
    )


def pack_detail(findings: DataFrame) -> DataFrame:
    """Common columns plus every other column as one JSON text, so that detectors can be unioned."""
    own = [c for c in findings.columns if c not in COMMON]
    op_excl = F.lit(None).cast("array<string>")
    for op_id, texts in EXCLUSIONS.items():
        op_excl = F.when(F.col("op_id") == op_id, F.array(*[F.lit(t) for t in texts])).otherwise(op_excl)
    return findings.select(
        *COMMON,
        F.coalesce(op_excl, F.array().cast("array<string>")).alias("exclusions"),
        (F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("detail"),
    )
