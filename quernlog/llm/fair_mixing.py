"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is given a place in a shuffled order of that source; its virtual finish time is the number
of words of the source up to and including it, divided by the source's target.  Taken in the order of their finish
times, all sources advance in proportion to their targets, and the mix ends where the budget is used up.  A source whose
target is above its size is gone through again, in another shuffled order.

Running totals come in two steps (totals of shuffle buckets, then a window inside a bucket), so no task holds a source,
whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.llm.native import text_of, words
from quernlog.session import materialized

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
PASSES = 2
#: Steps of the virtual clock per target; two levels of it place the end of the budget within a few rows.
_TICKS = 1024
_LAST_TICK = 4 * _TICKS - 1


def _numbered(docs: DataFrame, size: Column) -> DataFrame:
    """Rows with their size and a number among the rows of the same doc_id."""
    same = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size")
    return docs.withColumn("size", size).withColumn("copy", F.row_number().over(same))


def sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, passes: int = PASSES) -> DataFrame:
    """One row per source: source_size and target.

    Weights are given in code point order of the names, null last, and start anew after the last.  A target ends at
    ``passes`` times the size; what that cuts off goes to the other sources by weight, until no target is above.
    One row per source is ordered in one task.
    """
    everything = Window.partitionBy(F.lit(1))
    by_fill = everything.orderBy("fill", F.col("source").asc_nulls_last())
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    table = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", table[F.pmod(place, F.lit(len(weights)))])
    return (
        one.withColumn("fill", F.lit(passes) * F.col("source_size") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(percent) / F.lit(100))
        .withColumn(
            "level",  # words per unit of weight if all sources that fill before this one stop at their limit
            (F.col("budget") - F.coalesce(F.sum(F.lit(passes) * F.col("source_size")).over(upto), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))),
        )
        .withColumn("level", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(everything)["level"])
        .withColumn(
            "target",
            F.when(F.col("level").isNull() | (F.col("fill") <= F.col("level")), (F.lit(passes) * F.col("source_size")).cast("double"))
            .otherwise(F.col("weight") * F.col("level")),
        )
        .select("source", "source_size", "target", "budget", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"))
    )


def _finish_times(sized: DataFrame, per_source: DataFrame, passes: int, seed: str) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", "pass").cast("binary"))
    turns = (
        sized.select("doc_id", "copy", "size", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("place", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
        .withColumn("bucket", F.shiftright("place", 50).cast("int"))
    )
    before = Window.partitionBy("queue").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        turns.groupBy("queue", "pass", "bucket").agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(per_source.select("queue", "source_size", "target"), "queue")
        .drop("words")
    )
    inside = Window.partitionBy("queue", "pass", "bucket").orderBy("place", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    return (
        turns.withColumn("inside", F.sum("size").over(inside))
        .join(totals, ["queue", "pass", "bucket"])
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("before") + F.col("inside")) / F.col("target")).otherwise(F.lit(0.0)))
        .select("doc_id", "copy", "pass", "size", "place", "source_size", "target", "finish")
    )


def _crossing(rows: DataFrame, tick: str, used: int, budget: float) -> tuple[int, int]:
    """The tick in which the budget ends and the words before it; at most 4096 rows come to the driver."""
    for row in rows.groupBy(tick).agg(F.sum("size").alias("words")).orderBy(tick).toLocalIterator():
        if used + row["words"] > budget:
            return row[tick], used
        used += row["words"]
    return _LAST_TICK + 1, used


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, copy, size, source) to (doc_id, copy, size, source_size, target, taken, times).

    ``times`` is how often the document is in the mix and ``taken`` that many times its size.  Documents without words
    count nothing and may be in the mix; a null source is a source of its own; an empty table gives no rows.  Equal
    finish times are ordered by place, doc_id, copy and pass, so reruns agree.
    """
    per_source = materialized(sources(sized, weights, percent, passes))
    head = per_source.select("budget").first()
    turns = materialized(_finish_times(sized, per_source, passes, seed))
    budget = float(head["budget"]) if head else 0.0
    clock = F.col("finish") * _TICKS
    turns = turns.withColumn("tick", F.least(F.floor(clock), F.lit(_LAST_TICK)).cast("int"))
    turns = turns.withColumn("part", F.least(F.floor((clock - F.col("tick")) * _TICKS), F.lit(_LAST_TICK)).cast("int"))
    tick, used = _crossing(turns.select("tick", "size"), "tick", 0, budget)
    last = turns.filter(F.col("tick") == tick)
    part, used = _crossing(last.select("part", "size"), "part", used, budget)
    order = Window.partitionBy("tick", "part").orderBy("finish", "place", "doc_id", "copy", "pass").rowsBetween(Window.unboundedPreceding, 0)
    edge = last.filter(F.col("part") == part).withColumn("fits", F.sum("size").over(order) + F.lit(used) <= F.lit(budget))
    whole = turns.filter((F.col("tick") != tick) | (F.col("part") != part)).withColumn(
        "fits", (F.col("tick") < tick) | ((F.col("tick") == tick) & (F.col("part") < part))
    )
    return (
        whole.unionByName(edge)
        .groupBy("doc_id", "copy")
        .agg(
            F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
            F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("taken"),
            F.sum(F.col("fits").cast("int")).alias("times"),
        )
    )


def sized_rows(docs: DataFrame) -> DataFrame:
    """The narrow rows that the mix works on, kept, so that texts are read once."""
    return materialized(_numbered(docs.select("doc_id", "source", F.size(words(text_of())).cast("long").alias("size")), F.col("size")))


def mix(docs: DataFrame, **params: object) -> DataFrame:
    """Shares of all documents in the mix, one row per row of ``docs``; see :func:`mix_sized`.

    Sizes are words between ASCII white space; null texts have size 0.  Rows that repeat a doc_id are separate.
    Columns of ``docs`` other than doc_id, text and source are not looked at.
    """
    return mix_sized(sized_rows(docs), **params)


def mixed_documents(docs: DataFrame, **params: object) -> DataFrame:
    """The documents of the mix with the columns of ``docs``; one that is taken twice is there twice."""
    shares = (
        mix(docs, **params).filter("times > 0").groupBy(F.col("doc_id").alias("_mixed_id"))
        .agg(F.map_from_entries(F.collect_list(F.struct("copy", "times"))).alias("_times"))
    )
    same = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "_size")
    numbered = docs.withColumn("_size", F.size(words(text_of()))).withColumn("_copy", F.row_number().over(same))
    return (
        numbered.join(shares, F.col("doc_id").eqNullSafe(F.col("_mixed_id")))
        .withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("_times")[F.col("_copy")], F.lit(0)).cast("int"))))
        .select(*docs.columns)
    )
