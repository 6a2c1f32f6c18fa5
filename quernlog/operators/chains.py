"""Failure-then-success chains and step sequences.

The two failure chains are greedy: a hit closes the episode and counting starts again.  Groups of
ordinary size are folded by one ``aggregate`` expression over their sorted rows.  A group above
``group_rows`` is never gathered: its counters come from chunked windows, the episode that follows
each possible starting point is found by distributed look-ups, and ``follow`` walks the episodes
that really happen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import event_id, key_text, promote, route, usable
from quernlog.operators.chunked import CHUNK, follow, with_next, with_prefix
from quernlog.operators.findings import finding
from quernlog.session import materialized

WEB = ("web_access",)
WINDOWS_LOG = ("windows_event_log",)
SOURCE = ["case_id", "source_id"]
GROUP_ROWS = 65_536
EPISODES = (
    "array<struct<line_no:bigint,ts:timestamp,fails:bigint,first_line:bigint,nth_line:bigint,"
    "nth_ts:timestamp,last_line:bigint,last_ts:timestamp>>"
)
STATE = ("fails", "first_line", "nth_line", "nth_ts", "last_line", "last_ts")


def _gap_seconds(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1e6


def split_by_size(rows: DataFrame, group: list[str], threshold: int, group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that can chain at all, parted into ordinary and oversized groups."""
    stats = (
        rows.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count_if("fail").alias("_fails"),
            F.max(F.when(~F.col("fail"), F.col("line_no"))).alias("_last_success"),
            F.min(F.when(F.col("fail"), F.col("line_no"))).alias("_first_fail"),
        )
        .filter((F.col("_fails") >= threshold) & (F.col("_last_success") > F.col("_first_fail")))
        .persist()
    )
    small = rows.join(stats.filter(F.col("_rows") <= group_rows).select(*group), group, "left_semi")
    oversized = stats.filter(F.col("_rows") > group_rows).select(*group)
    if oversized.isEmpty():
        return small, None
    return small, rows.join(oversized, group, "left_semi")


def _cleared() -> list[Column]:
    return [
        F.lit(None if name.endswith("ts") else 0).cast("timestamp" if name.endswith("ts") else "bigint").alias(name)
        for name in STATE
    ]


def _fold(rows: DataFrame, group: list[str], threshold: int, accept: Callable[[Column, Column], Column]) -> DataFrame:
    """Episodes of ordinary groups; ``accept(state, row)`` says whether a success closes the episode."""

    def step(state: Column, row: Column) -> Column:
        count = state["fails"] + 1
        failed = F.struct(
            count.alias("fails"),
            F.when(count == 1, row["line_no"]).otherwise(state["first_line"]).alias("first_line"),
            F.when(count == threshold, row["line_no"]).otherwise(state["nth_line"]).alias("nth_line"),
            F.when(count == threshold, row["ts"]).otherwise(state["nth_ts"]).alias("nth_ts"),
            row["line_no"].alias("last_line"),
            row["ts"].alias("last_ts"),
            state["episodes"].alias("episodes"),
        )
        episode = F.struct(
            row["line_no"].alias("line_no"), row["ts"].alias("ts"), *[state[c].alias(c) for c in STATE]
        )
        closed = F.struct(*_cleared(), F.concat(state["episodes"], F.array(episode)).alias("episodes"))
        return (
            F.when(row["fail"], failed)
            .when((state["fails"] >= threshold) & accept(state, row), closed)
            .otherwise(state)
        )

    start = F.struct(*_cleared(), F.array().cast(EPISODES).alias("episodes"))
    gathered = rows.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "ts", "fail"))).alias("_rows")
    )
    return gathered.select(
        *group, F.explode(F.aggregate("_rows", start, step, lambda s: s["episodes"])).alias("_e")
    ).select(*group, "_e.*")


def _episodes_from_edges(edges: DataFrame, rows: DataFrame, group: list[str], threshold: int) -> DataFrame:
    """Episode rows of the walked edges; the n-th failure of a group is looked up by its running count."""
    fails = rows.filter("fail")
    wanted = edges.withColumns({"_first": F.col("src") + 1, "_nth": F.col("src") + threshold})
    first = fails.select(*group, F.col("seen").alias("_first"), F.col("line_no").alias("first_line"))
    nth = fails.select(
        *group, F.col("seen").alias("_nth"), F.col("line_no").alias("nth_line"), F.col("ts").alias("nth_ts")
    )
    last = fails.select(
        *group, F.col("seen").alias("dst"), F.col("line_no").alias("last_line"), F.col("ts").alias("last_ts")
    )
    return (
        wanted.join(first, [*group, "_first"])
        .join(nth, [*group, "_nth"])
        .join(last, [*group, "dst"])
        .select(
            *group, "line_no", "ts", (F.col("dst") - F.col("src")).alias("fails"), "first_line",
            "nth_line", "nth_ts", "last_line", "last_ts",
        )
    )


def _counted(rows: DataFrame, group: list[str], chunk: int) -> DataFrame:
    return materialized(
        with_prefix(
            rows, group, "line_no", sums={"seen": F.col("fail").cast("bigint")},
            lasts={"last_fail": F.when(F.col("fail"), F.struct("line_no", "ts"))}, size=chunk,
        )
    )


def _oversized_latest_anchor(
    rows: DataFrame, group: list[str], threshold: int, window_seconds: int, chunk: int
) -> DataFrame:
    """Window measured from the latest failure: every success can be judged on its own row."""
    counted = _counted(rows, group, chunk)
    gap = _gap_seconds(F.col("ts"), F.col("last_fail.ts"))
    eligible = counted.filter(
        ~F.col("fail") & F.col("last_fail").isNotNull() & (gap.isNull() | (gap <= window_seconds))
    )
    # of successes with the same failure count only the first can ever close an episode
    nodes = eligible.groupBy(*group, F.col("seen").alias("dst")).agg(
        F.min(F.struct("line_no", "ts")).alias("_s")
    )
    starts = nodes.select(*group, F.col("dst").alias("src")).unionByName(
        nodes.select(*group).distinct().withColumn("src", F.lit(0).cast("bigint"))
    )
    # doubled positions: a look-up sits just below the first count it may use
    marks = nodes.select(
        *group, (F.col("dst") * 2).alias("_pos"), F.lit(None).cast("bigint").alias("src"), F.col("dst").alias("_node")
    ).unionByName(
        starts.select(
            *group, ((F.col("src") + threshold) * 2 - 1).alias("_pos"), "src",
            F.lit(None).cast("bigint").alias("_node"),
        )
    )
    edges = (
        with_next(marks, group, "_pos", {"dst": F.col("_node")}, size=chunk)
        .filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(*group, "src", "dst")
        .join(nodes, [*group, "dst"])
        .select(*group, "src", "dst", "_s.line_no", "_s.ts")
    )
    return _episodes_from_edges(follow(edges, group), counted, group, threshold)


def _dyadic(
    anchors: DataFrame, successes: DataFrame, group: list[str], window_seconds: int, chunk: int
) -> DataFrame:
    """First success in line order whose time is within the window of the anchor, times in any order.

    The time axis is cut into nested halves; the window is the union of a few such pieces, and in each
    piece the next success is an ordinary ordered look-up.  No anchor meets all successes of its group.
    """
    width = window_seconds * 1_000_000
    levels = (2 * width + 1).bit_length() + 1
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")

    filed = (
        successes.withColumn("_us", F.unix_micros("ts")).select("*", level)
        .withColumn("_piece", F.expr("shiftright(_us, _level)"))
        .select(*group, "_level", "_piece", "line_no", F.struct("line_no", "ts", "seen").alias("_s"),
                F.lit(None).cast("bigint").alias("src"))
    )
    bounds = anchors.withColumns(
        {"_lo": F.unix_micros("ts") - width, "_hi": F.unix_micros("ts") + width + 1}
    ).select("*", level)
    low = F.expr("shiftright(_lo + shiftleft(1L, _level) - 1, _level)")
    high = F.expr("shiftright(_hi, _level)")
    cover = (
        bounds.withColumns({"_l": low, "_h": high})
        .filter("_l < _h")
        .withColumn(
            "_piece",
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.pmod(F.col("_l"), F.lit(2)) == 1, F.col("_l")),
                        F.when(F.pmod(F.col("_h"), F.lit(2)) == 1, F.col("_h") - 1),
                    )
                )
            ),
        )
        .select(*group, "_level", "_piece", "line_no",
                F.lit(None).cast("struct<line_no:bigint,ts:timestamp,seen:bigint>").alias("_s"), "src")
    )
    found = with_next(
        filed.unionByName(cover), [*group, "_level", "_piece"], "line_no", {"_hit": F.col("_s")}, size=chunk
    )
    return found.filter("src is not null and _hit is not null").groupBy(*group, "src").agg(
        F.min("_hit").alias("_far")
    )


def _oversized_nth_anchor(
    rows: DataFrame, group: list[str], threshold: int, window_seconds: int, window_lines: int, chunk: int
) -> DataFrame:
    """Window measured from the N-th failure of the episode, by time or, without time, by lines."""
    counted = _counted(rows, group, chunk)
    successes = counted.filter(~F.col("fail")).select(*group, "line_no", "ts", "seen")
    starts = (
        successes.select(*group, F.col("seen").alias("src"))
        .distinct()
        .unionByName(successes.select(*group).distinct().withColumn("src", F.lit(0).cast("bigint")))
        .distinct()
    )
    anchors = starts.withColumn("_nth", F.col("src") + threshold).join(
        counted.filter("fail").select(*group, F.col("seen").alias("_nth"), "line_no", "ts"), [*group, "_nth"]
    ).select(*group, "src", "line_no", "ts")
    success = F.when(F.col("src").isNull(), F.struct("line_no", "ts", "seen"))
    marks = successes.withColumn("src", F.lit(None).cast("bigint")).unionByName(
        anchors.withColumn("seen", F.lit(None).cast("bigint"))
    )
    near = with_next(
        marks, group, "line_no",
        {
            "_any": success,
            "_untimed": F.when(F.col("ts").isNull(), success),
            "_timed": F.when(F.col("ts").isNotNull(), success),
        },
        size=chunk,
    ).filter("src is not null").checkpoint()

    def in_lines(name: str) -> Column:
        return F.when(F.col(f"{name}.line_no") - F.col("line_no") <= window_lines, F.col(name))

    in_time = _gap_seconds(F.col("_timed.ts"), F.col("ts")) <= window_seconds
    open_rows = near.filter(F.col("ts").isNotNull() & F.col("_timed").isNotNull() & ~in_time)
    far = _dyadic(
        open_rows.select(*group, "src", "line_no", "ts"), successes.filter("ts is not null"), group,
        window_seconds, chunk,
    )
    chosen = near.join(far, [*group, "src"], "left").withColumn(
        "_s",
        F.when(F.col("ts").isNull(), in_lines("_any")).otherwise(
            F.least(in_lines("_untimed"), F.when(in_time, F.col("_timed")), F.col("_far"))
        ),
    )
    edges = chosen.filter("_s is not null").select(
        *group, "src", F.col("_s.seen").alias("dst"), F.col("_s.line_no").alias("line_no"), F.col("_s.ts").alias("ts")
    )
    return _episodes_from_edges(follow(edges, group), counted, group, threshold)


def _with_raw(episodes: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """Original text and extra columns of the success rows (few), read back by anchor."""
    return episodes.join(events.select(*SOURCE, "line_no", *columns), [*SOURCE, "line_no"])


def bruteforce_chain(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    fail_threshold: int = 10,
    window_seconds: int = 600,
    window_lines: int = 2000,
    fail_status: tuple[str, ...] = ("401", "403"),
    success_status: tuple[str, ...] = ("200",),
    group_rows: int = GROUP_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """Many refused requests of a client followed by an accepted one, window from the N-th refusal."""
    threshold = max(2, fail_threshold)
    group = [*SOURCE, "f_src_ip"]
    web = promote(route(events, sources, WEB), ["src_ip", "status"])
    rows = web.filter(
        (F.col("f_src_ip") != "") & F.col("f_status").isin(*fail_status, *success_status)
    ).select(*group, "line_no", "ts", F.col("f_status").isin(*fail_status).alias("fail"))

    def accept(state: Column, row: Column) -> Column:
        timed = row["ts"].isNotNull() & state["nth_ts"].isNotNull()
        return F.when(timed, _gap_seconds(row["ts"], state["nth_ts"]) <= window_seconds).otherwise(
            row["line_no"] - state["nth_line"] <= window_lines
        )

    small, large = split_by_size(rows, group, threshold, group_rows)
    episodes = _fold(small, group, threshold, accept)
    if large is not None:
        episodes = episodes.unionByName(
            _oversized_nth_anchor(large, group, threshold, window_seconds, window_lines, chunk)
        )
    timed = F.col("ts").isNotNull() & F.col("nth_ts").isNotNull()
    return finding(
        _with_raw(episodes, events, ["raw"]), "web-bruteforce-chain", "src_ip", F.col("f_src_ip"),
        {
            "fail_count": F.col("fails"),
            "fail_first_line": F.col("first_line"),
            "fail_nth_line": F.col("nth_line"),
            "window_basis": F.when(timed, "seconds").otherwise("lines"),
            "window_actual": F.when(timed, _gap_seconds(F.col("ts"), F.col("nth_ts"))).otherwise(
                (F.col("line_no") - F.col("nth_line")).cast("double")
            ),
        },
        points=2, linked=True, snippet=F.col("raw"), ts=F.col("ts"),
    )


def auth_chain(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    fail_event: int = 4625,
    success_event: int = 4624,
    fail_threshold: int = 10,
    window_seconds: int = 600,
    group_rows: int = GROUP_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """Many failed logons of an account on a computer followed by a success, window from the latest failure."""
    threshold = max(2, fail_threshold)
    group = [*SOURCE, "f_computer", "d_TargetUserName"]
    log = promote(
        route(events, sources, WINDOWS_LOG), ["event_id", "computer"],
        ["TargetUserName", "LogonType", "IpAddress"],
    )
    rows = log.filter(
        event_id().isin(fail_event, success_event)
        & usable("d_TargetUserName")
        & ~F.endswith(F.col("d_TargetUserName"), F.lit("$"))
    ).select(*group, "line_no", "ts", (event_id() == fail_event).alias("fail"))

    def accept(state: Column, row: Column) -> Column:
        gap = _gap_seconds(row["ts"], state["last_ts"])
        return gap.isNull() | (gap <= window_seconds)

    small, large = split_by_size(rows, group, threshold, group_rows)
    episodes = _fold(small, group, threshold, accept)
    if large is not None:
        episodes = episodes.unionByName(
            _oversized_latest_anchor(large, group, threshold, window_seconds, chunk)
        )
    hits = _with_raw(episodes, log, ["raw", "d_LogonType", "d_IpAddress"])
    gap = _gap_seconds(F.col("ts"), F.col("last_ts"))
    return finding(
        hits, "host-auth-chain", "event_id", F.col("d_TargetUserName"),
        {
            "computer": F.col("f_computer"),
            "logon_type": F.col("d_LogonType"),
            "src_ip": F.col("d_IpAddress"),
            "fail_count": F.col("fails"),
            "fail_first_line": F.col("first_line"),
            "fail_nth_line": F.col("nth_line"),
            "fail_last_line": F.col("last_line"),
            "window_seconds": F.coalesce(gap, F.lit(-1.0)),
        },
        points=2, linked=True, snippet=F.col("raw"), ts=F.col("ts"),
    )


def sequence_chain(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    steps: list[tuple[str, list[str]]] | None = None,
    window_seconds: int = 300,
    key_fields: list[str] | None = None,
    min_first_step_count: int = 5,
) -> DataFrame:
    """After the last first-step event of a key, each later step follows within the window (time order)."""
    steps = steps or [("status", ["401", "403"]), ("status", ["200"])]
    key_fields = key_fields or ["src_ip", "path"]
    if not 2 <= len(steps) <= 3 or window_seconds <= 0:
        raise ValueError("two or three steps and a positive window are required")
    group = [*SOURCE, *[f"f_{k}" for k in key_fields]]
    web = promote(route(events, sources, WEB), [*key_fields, *[field for field, _ in steps]])
    untimed = web.filter(F.col("ts").isNull()).groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("no_ts"))
    rows = web.filter(F.col("ts").isNotNull())
    for field in key_fields:
        rows = rows.filter(usable(f"f_{field}"))

    def matches(step: tuple[str, list[str]]) -> Column:
        field, values = step
        return F.lower(f"f_{field}").isin([str(v).lower() for v in values])

    place = F.struct(F.unix_seconds("ts").alias("sec"), F.col("line_no").alias("line"))
    marked = rows.select(
        *group, place.alias("at"), *[matches(s).alias(f"step{i}") for i, s in enumerate(steps)]
    ).filter(" or ".join(f"step{i}" for i in range(len(steps))))
    chain = (
        marked.groupBy(*group)
        .agg(F.count_if("step0").alias("first_step_count"), F.max(F.when(F.col("step0"), F.col("at"))).alias("at0"))
        .filter(F.col("first_step_count") >= max(1, min_first_step_count))
    )
    for i in range(1, len(steps)):
        # one row per key on the chain side; the minimum is combined before the shuffle
        later = marked.filter(f"step{i}").select(*group, F.col("at").alias("_at"))
        found = (
            later.join(chain.select(*group, f"at{i - 1}"), group)
            .filter(
                (F.col("_at") > F.col(f"at{i - 1}"))
                & (F.col("_at.sec") - F.col(f"at{i - 1}.sec") <= window_seconds)
            )
            .groupBy(*group)
            .agg(F.min("_at").alias(f"at{i}"))
        )
        chain = chain.join(found, group)
    last = f"at{len(steps) - 1}"
    hits = chain.join(untimed, SOURCE, "left").withColumns(
        {"line_no": F.col(f"{last}.line"), "_ts": F.timestamp_seconds(F.col(f"{last}.sec"))}
    )
    return finding(
        hits, "web-sequence-chain", ",".join(key_fields), key_text(key_fields),
        {
            "first_step_count": F.col("first_step_count"),
            "chain_lines": F.array(*[F.col(f"at{i}.line") for i in range(len(steps))]),
            "first_step_last_sec": F.col("at0.sec"),
            "final_sec": F.col(f"{last}.sec"),
            "events_without_ts": F.coalesce("no_ts", F.lit(0)),
        },
        points=len(steps), linked=True, ts=F.col("_ts"),
    )
