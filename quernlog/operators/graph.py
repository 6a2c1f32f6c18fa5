"""Investigation graph kept as node, edge and anchor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.session import materialized

FANOUT_LIMIT, CHAPTER_LIMIT, CASE_LIMIT = 5, 30, 200
UNFINISHED = ["open", "awaiting_approval", "running"]


def with_chapter(nodes: DataFrame, rounds: int = 3) -> DataFrame:
    """Add ``chapter``: the nearest goal on the way up, the node itself included, NULL when there is none.

    Each round doubles the distance looked at.  The first ``rounds`` are one plan; nodes that are still on their way
    after them go on, round by round, until none is left or the distance is above the number of nodes (a circle).
    """
    is_goal = F.col("kind") == "goal"
    state = nodes.select(
        "case_id", "id", F.when(is_goal, F.col("id")).alias("chapter"), F.when(~is_goal, F.col("parent_id")).alias("_up")
    )

    def doubled(rows: DataFrame) -> DataFrame:
        above = rows.select("case_id", F.col("id").alias("_up"), F.col("chapter").alias("_c"), F.col("_up").alias("_next"))
        return rows.join(above, ["case_id", "_up"], "left").select(
            "case_id", "id", F.coalesce("chapter", "_c").alias("chapter"),
            F.when(F.col("chapter").isNull() & F.col("_c").isNull(), F.col("_next")).alias("_up"),
        )

    for _ in range(rounds):
        state = doubled(state)
    state = materialized(state)
    reach = 2**rounds
    while not state.filter("_up is not null").isEmpty() and reach <= 2 * state.count():
        state, reach = materialized(doubled(state)), 2 * reach
    return nodes.join(state.select("case_id", "id", "chapter"), ["case_id", "id"])


def _chapter_intents(nodes: DataFrame) -> DataFrame:
    return with_chapter(nodes).filter((F.col("kind") == "intent") & (F.col("status") != "parked"))


def goal_verdicts(nodes: DataFrame) -> DataFrame:
    """Goals with the counts of their chapter's intents and the resulting verdict."""
    counts = _chapter_intents(nodes).groupBy("case_id", "chapter").agg(
        F.count(F.lit(1)).alias("intents"),
        F.count_if(F.col("status").isin(UNFINISHED)).alias("unfinished"),
        F.count_if(F.col("status") == "supported").alias("supported"),
    )
    goals = nodes.filter(F.col("kind") == "goal").select("case_id", "id", "status")
    joined = goals.join(counts.withColumnRenamed("chapter", "id"), ["case_id", "id"], "left")
    filled = joined.select("case_id", "id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("intents", "unfinished", "supported")])
    machine = F.col("status").isin("open", "closed_goal_met", "closed_goal_unmet", "closed_goal_partial")
    verdict = (
        F.when(~machine | (F.col("intents") == 0), F.col("status"))
        .when(F.col("unfinished") > 0, "open")
        .when(F.col("supported") == F.col("intents"), "closed_goal_met")
        .when(F.col("supported") == 0, "closed_goal_unmet")
        .otherwise("closed_goal_partial")
    )
    return filled.withColumn("verdict", verdict)


def _automatic(kind: str = "kind") -> Column:
    return (F.col(kind) == "intent") & (F.col("created_by") != "human") & (F.col("status") != "parked")


def budget_gates(
    nodes: DataFrame, fanout: int = FANOUT_LIMIT, chapter: int = CHAPTER_LIMIT, case: int = CASE_LIMIT
) -> DataFrame:
    """Why an intent may not spawn another one: 'fanout', 'chapter', 'case', or NULL when it may."""
    chaptered = with_chapter(nodes)
    children = nodes.filter(F.col("kind") == "intent").groupBy("case_id", F.col("parent_id").alias("id")).agg(
        F.count(F.lit(1)).alias("children")
    )
    per_chapter = chaptered.filter(_automatic()).groupBy("case_id", "chapter").agg(F.count(F.lit(1)).alias("in_chapter"))
    per_case = nodes.filter(_automatic()).groupBy("case_id").agg(F.count(F.lit(1)).alias("in_case"))
    joined = (
        chaptered.filter(F.col("kind") == "intent")
        .select("case_id", "id", "chapter")
        .join(children, ["case_id", "id"], "left")
        .join(per_chapter, ["case_id", "chapter"], "left")
        .join(per_case, "case_id", "left")
    )
    filled = joined.select("case_id", "id", "chapter", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "in_chapter", "in_case")])
    reason = (
        F.when(F.col("children") >= fanout, "fanout")
        .when(F.col("chapter").isNotNull() & (F.col("in_chapter") >= chapter), "chapter")
        .when(F.col("in_case") >= case, "case")
    )
    return filled.withColumn("reason", reason)


def budget_status(nodes: DataFrame) -> DataFrame:
    """Automatic intents per goal, next to the case total and the number of parked intents."""
    used = with_chapter(nodes).filter(_automatic()).groupBy("case_id", F.col("chapter").alias("id")).agg(F.count(F.lit(1)).alias("intents"))
    totals = nodes.groupBy("case_id").agg(
        F.count_if(_automatic()).alias("case_intents"),
        F.count_if((F.col("kind") == "intent") & (F.col("status") == "parked")).alias("parked"),
    )
    goals = nodes.filter(F.col("kind") == "goal").select("case_id", "id")
    return goals.join(used, ["case_id", "id"], "left").join(totals, "case_id").select(
        "case_id", F.col("id").alias("goal_id"), F.coalesce("intents", F.lit(0)).alias("intents"), "case_intents", "parked"
    )


def blackboard(nodes: DataFrame, edges: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Shared notes of a case: proven facts, doubts, intents (active ones first) and parked intents.

    ``limits`` cuts the sections it names; ``section_total`` is the full number of entries.
    """
    proven = edges.filter(F.col("kind") == "proves").select("case_id", F.col("from_id").alias("id")).distinct()
    intent, status = F.col("kind") == "intent", F.col("status")
    facts = nodes.filter(F.col("kind") == "fact").join(proven, ["case_id", "id"], "left_semi")
    entries = (
        facts.withColumns({"section": F.lit("fact"), "_group": F.lit(0)})
        .unionByName(nodes.filter(intent & (status == "doubt")).withColumns({"section": F.lit("doubt"), "_group": F.lit(0)}))
        .unionByName(
            nodes.filter(intent & (status != "parked")).withColumns(
                {"section": F.lit("intent"), "_group": F.when(status.isin(UNFINISHED), 0).otherwise(1)}
            )
        )
        .unionByName(nodes.filter(intent & (status == "parked")).withColumns({"section": F.lit("parked"), "_group": F.lit(0)}))
    )
    limit = F.lit(None).cast("int")
    for section, value in (limits or {}).items():
        limit = F.when(F.col("section") == section, value).otherwise(limit)
    totals = entries.groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("section_total"))
    ranked = Window.partitionBy("case_id", "section").orderBy("_group", "created_at", "id")
    top = entries.withColumn("position", F.row_number().over(ranked)).filter(limit.isNull() | (F.col("position") <= limit))
    return top.join(totals, ["case_id", "section"]).select("case_id", "section", "position", "id", "text", "status", "section_total")
