"""Tables of a case report.

Inputs: hits with hit_id, nodes, fact anchors (node_id, source_id, line_no, hit_id) and sources.  Tables hold every
row unless the caller gives a limit; a limit counts for each case on its own, and every row tells its case's total and
whether the case was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.operators.graph import with_chapter
from quernlog.operators.review import severity_rank


def _per_case(rows: DataFrame, order: list[Column | str], limit: int | None, total: str, **wholes: Column) -> DataFrame:
    """Rows with their case's total (and further aggregates), the first ``limit`` of each case."""
    whole = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias(total), *[c.alias(n) for n, c in wholes.items()])
    if limit is None:
        return rows.join(whole, "case_id").withColumn("truncated", F.lit(False))
    ranked = rows.withColumn("_row", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
    first = ranked.filter(F.col("_row") <= limit).drop("_row")
    return first.join(whole, "case_id").withColumn("truncated", F.col(total) > limit)


def cut(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def _place(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", "host", F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256"))


def chapters(nodes: DataFrame) -> DataFrame:
    """Goals with the number of intents in their chapter and how many are supported."""
    intents = (
        with_chapter(nodes)
        .filter((F.col("kind") == "intent") & (F.col("status") != "parked") & F.col("chapter").isNotNull())
        .groupBy("case_id", F.col("chapter").alias("goal_id"))
        .agg(F.count(F.lit(1)).alias("intents_total"), F.count_if(F.col("status") == "supported").alias("intents_supported"))
    )
    goals = nodes.filter(F.col("kind") == "goal").select(
        "case_id", F.col("id").alias("goal_id"), F.col("text").alias("goal_text"), "status"
    )
    return goals.join(intents, ["case_id", "goal_id"], "left").select(
        "case_id", "goal_id", "goal_text", "status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("intents_total", "intents_supported")],
    )


def facts(nodes: DataFrame, anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """Confirmed facts with evidence, one row per anchor, under their chapter (NULL when outside any)."""
    confirmed = with_chapter(nodes).filter((F.col("kind") == "fact") & F.col("status").isin("supported", "closed"))
    return (
        confirmed.select("case_id", F.col("id").alias("node_id"), "text", "chapter")
        .join(anchors.select("case_id", "node_id", "source_id", "line_no", "hit_id"), ["case_id", "node_id"])
        .join(_place(sources), "source_id", "left")
        .select(
            "case_id", F.col("node_id").alias("fact_id"), "text", F.col("chapter").alias("goal_id"), "source_id", "line_no",
            "hit_id", "host", "source_path", "source_sha256",
        )
    )


def findings(hits: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Accepted candidates; with a limit the most severe ones of each case."""
    accepted = hits.filter(F.col("status") == "accepted").withColumn("_rank", severity_rank())
    top = _per_case(accepted, ["_rank", "created_at", "hit_id"], limit, "findings_total")
    return top.join(_place(sources), "source_id", "left").drop("_rank")


def _timeline_items(hits: DataFrame, fact_rows: DataFrame, found: DataFrame) -> DataFrame:
    snippet = F.when(F.col("snippet") != "", F.concat(F.lit(":"), cut(F.col("snippet"), 80))).otherwise("")
    shown = found.filter(F.col("ts").isNotNull()).select(
        "case_id", "ts", F.lit("finding").alias("kind"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("rule_id"), snippet).alias("text"),
        F.lit("").alias("fact_id"), "source_id", "line_no",
    )
    resolved = (
        fact_rows.filter(F.col("hit_id").isNotNull())
        .select("case_id", "fact_id", cut(F.col("text"), 120).alias("text"), "hit_id")
        .join(hits.filter(F.col("ts").isNotNull()).select("case_id", "hit_id", "ts", "source_id", "line_no"), ["case_id", "hit_id"])
        .select("case_id", "ts", F.lit("fact").alias("kind"), "text", "fact_id", "source_id", "line_no")
    )
    key = ["case_id", F.unix_seconds("ts").alias("sec"), "kind", "text", "source_id", "line_no"]
    return shown.unionByName(resolved).groupBy(*key).agg(F.min("ts").alias("ts"), F.min("fact_id").alias("fact_id"))


def timeline(hits: DataFrame, fact_rows: DataFrame, found: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct entries, with a limit the earliest of each case; every row carries the full count and time window.

    ``found`` must be all accepted findings: totals and windows are taken over them.
    """
    items = _timeline_items(hits, fact_rows, found)
    order = ["ts", "kind", "text", "source_id", "line_no"]
    first = _per_case(items, order, limit, "timeline_total", window_from=F.min("ts"), window_to=F.max("ts"))
    return first.join(_place(sources), "source_id", "left")


def evidence(hits: DataFrame, fact_rows: DataFrame, found: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Places the report refers to with the number of references; with a limit the first of each case by place."""
    by_hit = hits.select("case_id", "hit_id", F.col("source_id").alias("_s"), F.col("line_no").alias("_l"))
    cited = fact_rows.join(by_hit, ["case_id", "hit_id"], "left")
    direct = F.coalesce("source_id", F.lit("")) != ""
    from_facts = cited.select(
        "case_id", F.when(direct, F.col("source_id")).otherwise(F.col("_s")).alias("source_id"),
        F.when(direct, F.col("line_no")).otherwise(F.col("_l")).alias("line_no"),
    ).filter(F.coalesce("source_id", F.lit("")) != "")
    refs = (
        found.select("case_id", "source_id", "line_no").unionByName(from_facts)
        .groupBy("case_id", "source_id", "line_no").agg(F.count(F.lit(1)).alias("refs"))
    )
    order = [F.coalesce("host", F.lit("")), F.coalesce("source_path", F.lit("")), "line_no", "source_id"]
    return _per_case(refs.join(_place(sources), "source_id", "left"), order, limit, "evidence_total")


def verdict_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("case_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "accepted", "rejected")]
    )
