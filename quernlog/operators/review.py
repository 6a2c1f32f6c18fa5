"""Candidate table: rounds, caps, verdicts, statistics, and the case dashboards derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import domain_columns, in_domain
from quernlog.operators.findings import pack_detail
from quernlog.operators.rules import KEY, with_outcome

MAX_BATCH, REVIEW_DECISIONS = 500, 10
SEVERITY_ORDER = ["high", "medium", "low", "info"]


def severity_rank(severity: str | Column = "severity") -> Column:
    column = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(len(SEVERITY_ORDER))
    for rank, name in enumerate(SEVERITY_ORDER):
        out = F.when(column == name, rank).otherwise(out)
    return out


def next_round(runs: DataFrame, case_id: str) -> int:
    """Number of the next scan round (or report version) of a case."""
    return runs.filter(F.col("case_id") == case_id).agg(F.coalesce(F.max("round_no"), F.lit(0)) + 1).first()[0]


def next_rounds(runs: DataFrame) -> DataFrame:
    """The next round number of every case that has runs."""
    return runs.groupBy("case_id").agg((F.max("round_no") + 1).alias("next_round"))


def findings_to_hits(findings: DataFrame, severities: dict[str, str], default: str = "medium") -> DataFrame:
    """Detector findings as candidate rows; each operator's own columns go into ``detail``."""
    packed = pack_detail(findings)
    severity = F.lit(default)
    for op_id, value in severities.items():
        severity = F.when(F.col("op_id") == op_id, value).otherwise(severity)
    return packed.select(
        "case_id", "source_id", "line_no", F.col("op_id").alias("rule_id"), severity.alias("severity"), "matched_field",
        "matched_value", "snippet", "ts", "evidence_grade", "detail",
    ).dropDuplicates(KEY)


def store_hits(fresh: DataFrame, stored: DataFrame | None, round_no: int, cap: int | dict[str, int] | None = None) -> DataFrame:
    """Rows to append this round: the new ones (within the cap, if one is given), pending, stamped with the round."""
    kept = with_outcome(fresh, stored, cap).filter("outcome = 'new'").drop("outcome")
    return kept.withColumns(
        {"status": F.lit("pending"), "round_no": F.lit(round_no), "created_at": F.current_timestamp()}
    )


def operator_summary(outcomes: DataFrame, sources: DataFrame, domains: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Per operator: sources in and out of its domain, new, dup and truncated findings."""
    counted = outcomes.groupBy(F.col("rule_id").alias("op_id")).agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("outcome") == o).alias(a) for o, a in (("new", "hits_new"), ("dup", "hits_dup"), ("truncated", "truncated"))],
    )
    parts = [
        F.struct(
            F.lit(op).alias("op_id"),
            F.count_if(in_domain(*d)).alias("matched_sources"),
            F.count_if(~in_domain(*d)).alias("skipped_domain"),
        )
        for op, d in domains.items()
    ]
    assert all(set(domain_columns(*d)) <= set(sources.columns) for d in domains.values())
    routed = sources.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", "hits_new", "hits_dup", "truncated")]
    return routed.join(counted, "op_id", "left").select("op_id", "matched_sources", "skipped_domain", *zero)


def apply_verdicts(hits: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated hits, result per id): only pending rows change, a second verdict on a row is refused.

    ``batch`` has hit_id, verdict (accepted or rejected), reviewer and position; the first of repeated
    ids counts.
    """
    unique = batch.groupBy("hit_id").agg(F.min_by(F.struct("verdict", "reviewer"), "position").alias("_v")).select("hit_id", "_v.*")
    joined = hits.join(unique, "hit_id", "left")
    change = F.col("verdict").isNotNull() & (F.col("status") == "pending")
    updated = joined.withColumns(
        {
            "reviewed_by": F.when(change, F.col("reviewer")).otherwise(F.col("reviewed_by")),
            "reviewed_at": F.when(change, F.current_timestamp()).otherwise(F.col("reviewed_at")),
            "status": F.when(change, F.col("verdict")).otherwise(F.col("status")),
        }
    ).select(hits.columns)
    result = unique.join(hits.select("hit_id", "status"), "hit_id", "left").select(
        "hit_id",
        F.when(F.col("status").isNull(), "missing").when(F.col("status") == "pending", "ok").otherwise("conflict").alias("result"),
    )
    return updated, result


def rule_statistics(hits: DataFrame, rules: DataFrame, since: Column | str) -> DataFrame:
    """Candidates and decisions per rule since a time; silent rules are listed with zeros."""
    at = F.lit(since).cast("timestamp") if isinstance(since, str) else since
    counted = hits.filter(F.col("created_at") >= at).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "pending")],
    )
    joined = rules.select("rule_id").distinct().join(counted, "rule_id", "full_outer")
    filled = joined.select("rule_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "accepted", "rejected", "pending")])
    decided = F.col("accepted") + F.col("rejected")
    return filled.withColumns(
        {
            "acceptance_rate": F.when(decided > 0, F.col("accepted") / decided),
            "needs_review": (decided >= REVIEW_DECISIONS) & (F.col("accepted") == 0),
        }
    )


def list_hits(
    hits: DataFrame, *, status: str | None = None, round_no: int | None = None, source_ids: tuple[str, ...] = (),
    limit: int | None = 100, offset: int = 0, after: tuple | None = None,
) -> DataFrame:
    """One page of candidates in creation order, all of them without a limit.

    ``after`` is the (created_at, source_id, line_no, rule_id) of the last candidate seen; going on from there is a
    filter, while ``offset`` passes over all rows before.
    """
    rows = hits
    if status:
        rows = rows.filter(F.col("status") == status)
    if round_no is not None:
        rows = rows.filter(F.col("round_no") == round_no)
    if source_ids:
        rows = rows.filter(F.col("source_id").isin(*source_ids))
    order = ("created_at", "source_id", "line_no", "rule_id")
    if after is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after)]))
    rows = rows.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def rule_seeds(summary: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with new candidates, with their titles, as starting points of an investigation."""
    return summary.filter(F.col("hits_new") > 0).join(rules.select("rule_id", "title"), "rule_id", "left").select(
        "rule_id", "title", "hits_new"
    )


# ---- sources and coverage -------------------------------------------------------------------------


def with_latest_job(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each source with its most recent ingest job."""
    latest = jobs.groupBy("source_id").agg(
        F.max_by(F.struct(F.col("status").alias("job_status"), "parser", "rows_total"), F.col("started_at")).alias("_j")
    ).select("source_id", "_j.*")
    return sources.join(latest, "source_id", "left")


def source_status(rows: DataFrame) -> DataFrame:
    """Reading state of a source from its format guess and latest job."""
    state = (
        F.when(F.col("detect_status") == "pending_confirm", "awaiting confirmation")
        .when(F.col("detect_status") == "suspect", "suspect")
        .when(F.col("job_status").isNull(), "not ingested")
        .when(F.col("job_status") == "failed", "failed")
        .when(F.col("job_status") == "running", "running")
        .when(F.col("parser") == "raw", "registered")
        .otherwise("parsed")
    )
    return rows.withColumn("state", state)


def coverage(sources: DataFrame, anchors: DataFrame, nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Per source: investigations that touched it, facts found in it, candidates raised from it.

    Anchors are first reduced to distinct (source, node) pairs, counts come in pre-aggregated.
    """
    pairs = anchors.select("source_id", F.col("node_id").alias("id")).distinct()
    touched = (
        pairs.join(nodes.select("id", "kind"), "id", "left")
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("intents"), F.count_if(F.col("kind") == "fact").alias("facts"))
    )
    raised = hits.groupBy("source_id").agg(F.count(F.lit(1)).alias("hits"))
    joined = sources.join(touched, "source_id", "left").join(raised, "source_id", "left")
    return joined.select(
        *sources.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("intents", "facts", "hits")],
        F.col("intents").isNotNull().alias("explored"),
    )


def coverage_rollup(covered: DataFrame) -> DataFrame:
    """Totals per host and per package within a host ('package' is NULL on host rows)."""
    return (
        covered.rollup("host", "package")
        .agg(
            F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("sources_total"),
            F.count_if("explored").alias("explored"),
        )
        .filter(F.col("_level") <= 1)
        .select("host", F.when(F.col("_level") == 0, F.col("package")).alias("package"), "sources_total", "explored")
    )


def content_tree(sources: DataFrame) -> DataFrame:
    """Every directory on the way to a source with the number of sources below it and its depth."""
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth"))
    )
    nested = sources.filter(F.size(parts) > 1).select("case_id", F.inline(prefixes))
    return nested.groupBy("case_id", "dir", "depth").agg(F.count(F.lit(1)).alias("sources"))


# ---- dashboards -----------------------------------------------------------------------------------


def case_counts(cases: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """Active cases with source, candidate and pending counts and the bucket they fall into."""
    active = cases.filter(F.col("archived_at").isNull())
    per_source = sources.groupBy("case_id").agg(F.count(F.lit(1)).alias("sources"))
    per_hit = hits.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "pending").alias("pending")
    )
    joined = active.select("case_id").join(per_source, "case_id", "left").join(per_hit, "case_id", "left")
    filled = joined.select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sources", "candidates", "pending")])
    bucket = (
        F.when(F.col("pending") > 0, "pending").when(F.col("candidates") > 0, "reviewed")
        .when(F.col("sources") > 0, "ingested").otherwise("empty")
    )
    return filled.withColumn("bucket", bucket)


def overview(cases: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: totals over active cases, case buckets, number of archived cases."""
    archived = cases.filter(F.col("archived_at").isNotNull()).select(F.count(F.lit(1))).scalar()
    return case_counts(cases, sources, hits).agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sources", "candidates", "pending")],
        *[F.count_if(F.col("bucket") == b).alias(f"cases_{b}") for b in ("pending", "reviewed", "ingested", "empty")],
    ).withColumn("archived_cases", archived)


def daily_activity(audit: DataFrame, now: Column | str, days: int = 7) -> DataFrame:
    """Audit entries per UTC day over the last days."""
    until = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return (
        audit.filter(F.col("ts") >= until - F.make_dt_interval(F.lit(days)))
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("entries"))
    )
