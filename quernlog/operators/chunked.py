"""Ordered computations over groups of any size.

A window over a whole group is one task's work, however large the group.  Here the order column is
cut into chunks: the window runs inside (group, chunk), one small row per chunk carries the totals,
and a second window runs over those rows only.  No task sees more than one chunk of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.session import materialized

CHUNK = 1 << 22


def chunk_of(order: str, size: int = CHUNK) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def with_prefix(
    rows: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    size: int = CHUNK,
) -> DataFrame:
    """Add inclusive running ``sums`` and, for ``lasts``, the latest non-null value strictly before a row."""
    sums, lasts = sums or {}, lasts or {}
    base = rows.withColumn("_chunk", chunk_of(order, size)).withColumns(
        {f"_s_{k}": v for k, v in sums.items()} | {f"_l_{k}": v for k, v in lasts.items()}
    )
    totals = base.groupBy(*group, "_chunk").agg(
        *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums],
        *[
            F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.col(order))).alias(f"_t_{k}")
            for k in lasts
        ],
    )
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.last(f"_t_{k}", ignorenulls=True).over(earlier).alias(f"_o_{k}") for k in lasts],
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns(
        {f"_w_{k}": F.sum(f"_s_{k}").over(upto) for k in sums}
        | {f"_w_{k}": F.last(f"_l_{k}", ignorenulls=True).over(before) for k in lasts}
    )
    joined = local.join(offsets, [*group, "_chunk"])
    return joined.select(
        *rows.columns,
        *[(F.col(f"_w_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums],
        *[F.coalesce(f"_w_{k}", f"_o_{k}").alias(k) for k in lasts],
    )


def with_next(
    rows: DataFrame, group: list[str], order: str, values: dict[str, Column], size: int = CHUNK
) -> DataFrame:
    """Add, for each named value, the first non-null one strictly after a row."""
    base = rows.withColumn("_chunk", chunk_of(order, size)).withColumns(
        {f"_v_{k}": v for k, v in values.items()}
    )
    firsts = base.groupBy(*group, "_chunk").agg(
        *[
            F.min_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col(order))).alias(f"_f_{k}")
            for k in values
        ]
    )
    later = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    offsets = firsts.select(
        *group,
        "_chunk",
        *[F.first(f"_f_{k}", ignorenulls=True).over(later).alias(f"_o_{k}") for k in values],
    )
    after = (
        Window.partitionBy(*group, "_chunk").orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # scanning downwards the nearest later value is the last one seen
    local = base.withColumns(
        {f"_w_{k}": F.last(f"_v_{k}", ignorenulls=True).over(after) for k in values}
    )
    joined = local.join(offsets, [*group, "_chunk"])
    return joined.select(
        *rows.columns, *[F.coalesce(f"_w_{k}", f"_o_{k}").alias(k) for k in values]
    )


def follow(edges: DataFrame, group: list[str], start: int = 0) -> DataFrame:
    """Edges (group, src, dst) that lie on the path leaving ``start`` in every group.

    Each src has at most one edge and dst > src.  Path doubling: after round k all nodes within
    2^k steps are known, so the number of rounds grows with the logarithm of the longest path and
    every round is a distributed join.
    """
    edges = materialized(edges)
    jump = edges.select(*group, "src", "dst")
    reached = edges.select(*group).distinct().withColumn("src", F.lit(start).cast("bigint"))
    while True:
        found = reached.join(jump, [*group, "src"]).select(*group, F.col("dst").alias("src")).checkpoint()
        if found.isEmpty():
            break
        reached = reached.unionByName(found)
        onward = jump.select(*group, F.col("src").alias("dst"), F.col("dst").alias("_to"))
        jump = (
            jump.join(onward, [*group, "dst"]).select(*group, "src", F.col("_to").alias("dst")).checkpoint()
        )
    return edges.join(reached, [*group, "src"], "left_semi")


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order of their group, from 1; ties must be settled by ``order``.

    Rows are sorted over ranges, numbered within each, and raised by the counts of the ranges before, so a group of any
    size is spread over many tasks.
    """
    spread = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    spread = materialized(spread)
    counts = spread.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_range", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in [*group, "_range"]]
    numbered = spread.withColumn(name, F.row_number().over(inside)).alias("l")
    joined = numbered.join(offsets.alias("r"), same)
    return joined.select("l.*", "_offset").withColumn(name, (F.col(name) + F.col("_offset")).cast("int")).drop("_offset", "_range")


#: A range with at most so many values, or one only, is counted value by value; larger ones are cut into so many bins.
SETTLED, BINS = 65_536, 4096


def exact_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact median and count per group: (group, n, median), the middle two averaged when n is even.

    The range that holds a middle rank is narrowed by counting: first by magnitude, in steps of about 1 %, then, on the rows
    of that step alone, into ``BINS`` bins of equal width until at most ``SETTLED`` values or a single one is
    left.  No task sees more than the bins of a group or those last values, whatever the group's size and values.
    """
    v = F.col("_v")
    step = F.when(v > 0, F.floor(F.log2(v) * 64)).when(v < 0, -F.floor(F.log2(-v) * 64) - 1_000_000).otherwise(-500_000)
    stepped = rows.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null").withColumn("_bin", step.cast("bigint"))
    by_bin = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = stepped.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumns(
        {"_before": F.coalesce(F.sum("_c").over(by_bin), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy(*group))}
    )
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    holds = (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_c"))
    picked = counts.withColumn("_rank", F.explode(ranks)).filter(holds).drop("_c")
    target = [*group, "_rank"]
    inside = materialized(stepped.join(picked, [*group, "_bin"]).drop("_bin"))
    while True:
        span = materialized(inside.groupBy(*target).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_k")))
        wide = (F.col("_k") > SETTLED) & (F.col("_low") < F.col("_high"))
        if span.filter(wide).isEmpty():
            break
        part = F.least(F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1))
        binned = inside.join(span, target).withColumn("_bin", F.when(wide, part).otherwise(0).cast("bigint"))
        along = Window.partitionBy(*target).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = binned.groupBy(*target, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"))
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_c").over(along), F.lit(0)))
        picked = counts.filter(holds).select(*target, "_bin", "_before")
        inside = materialized(binned.drop("_before", "_low", "_high", "_k").join(picked, [*target, "_bin"]).drop("_bin"))
    by_value = Window.partitionBy(*target).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = inside.groupBy(*target, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("n").alias("n"))
    values = values.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_c").over(by_value), F.lit(0))).filter(holds)
    return values.groupBy(*group).agg(F.max("n").alias("n"), F.avg("_v").alias("median"))
