"""Statistical detectors over web access events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.data.excludes import BROWSER_UA_PATTERNS, COMMON_UA_TOKENS
from quernlog.functions.fields import key_text, promote, route, usable
from quernlog.operators.chunked import CHUNK, chunk_of, exact_median
from quernlog.operators.findings import finding

WEB = ("web_access",)
SOURCE = ["case_id", "source_id"]


def _web(events: DataFrame, sources: DataFrame | None, keys: list[str]) -> DataFrame:
    routed = route(events, sources, WEB)
    return promote(routed, keys).select(*SOURCE, "line_no", "ts", *[f"f_{k}" for k in dict.fromkeys(keys)])


def beacon_periodicity(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    min_samples: int = 12,
    min_span_seconds: int = 3600,
    max_cv: float = 0.15,
    chunk: int = CHUNK,
) -> DataFrame:
    """Client addresses whose requests come at an almost constant interval (line order)."""
    group = [*SOURCE, "f_src_ip"]
    rows = (
        _web(events, sources, ["src_ip"])
        .filter(F.col("f_src_ip") != "")
        .withColumn("_chunk", chunk_of("line_no", chunk))
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    delta = (F.unix_micros("ts") - F.unix_micros("_prev")) / 1e6
    # the window leaves the rows placed by (group, chunk), so this aggregation adds no shuffle
    parts = (
        rows.withColumn("_prev", F.last("ts", ignorenulls=True).over(inside))
        .withColumn("_delta", F.when(delta > 0, delta))
        .groupBy(*group, "_chunk")
        .agg(
            F.count("ts").alias("samples"),
            F.count_if(F.col("ts").isNull()).alias("no_ts"),
            F.count("_delta").alias("_n"),
            F.avg("_delta").alias("_mean"),
            F.var_pop("_delta").alias("_var"),
            F.min_by(F.struct("ts", "line_no"), F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("_first"),
            F.max_by(F.struct("ts", "line_no"), F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("_last"),
        )
    )
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    step = (
        F.unix_micros(F.col("_first.ts")) - F.unix_micros(F.last("_last.ts", ignorenulls=True).over(earlier))
    ) / 1e6
    whole = Window.partitionBy(*group)
    linked = parts.withColumn("_bridge", step).withColumn(
        "_bridge", F.when(F.col("_bridge") > 0, F.col("_bridge"))
    )
    weight = F.col("_n") + F.when(F.col("_bridge").isNotNull(), 1).otherwise(0)
    total = F.coalesce(F.col("_n") * F.col("_mean"), F.lit(0.0)) + F.coalesce("_bridge", F.lit(0.0))
    centred = linked.withColumns({"_w": weight, "_t": total}).withColumn(
        "_centre", F.sum("_t").over(whole) / F.nullif(F.sum("_w").over(whole), F.lit(0))
    )
    spread = F.coalesce(
        F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_centre"), 2)), F.lit(0.0)
    ) + F.coalesce(F.pow(F.col("_bridge") - F.col("_centre"), 2), F.lit(0.0))
    stats = centred.groupBy(*group).agg(
        F.sum("samples").alias("samples"),
        F.sum("no_ts").alias("events_without_ts"),
        F.sum("_w").cast("bigint").alias("intervals"),
        F.first("_centre").alias("mean_interval_s"),
        F.sqrt(F.sum(spread) / F.nullif(F.sum("_w"), F.lit(0))).alias("stddev_interval_s"),
        F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("_chunk"))).alias("_first"),
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_chunk"))).alias("_last"),
    )
    span = (F.unix_micros(F.col("_last.ts")) - F.unix_micros(F.col("_first.ts"))) / 1e6
    cv = F.when(F.col("mean_interval_s") > 0, F.col("stddev_interval_s") / F.col("mean_interval_s")).otherwise(0.0)
    hits = stats.withColumns({"span_seconds": span, "cv": cv, "line_no": F.col("_last.line_no")}).filter(
        (F.col("samples") >= min_samples)
        & (F.col("intervals") >= 2)
        & (F.col("span_seconds") >= min_span_seconds)
        & (F.col("cv") <= max_cv)
    )
    detail = ["samples", "intervals", "span_seconds", "mean_interval_s", "stddev_interval_s", "cv", "events_without_ts"]
    return finding(
        hits, "web-beacon-periodicity", "src_ip", F.col("f_src_ip"), {c: F.col(c) for c in detail},
        statistical=True, ts=F.col("_last.ts"),
    )


def ip_rate_spike(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    bucket_seconds: int = 60,
    min_buckets: int = 10,
    z_threshold: float = 5.0,
    min_bucket_count: int = 100,
) -> DataFrame:
    """The busiest time bucket of a client when it stands out of that client's own bucket counts."""
    group = [*SOURCE, "f_src_ip"]
    rows = _web(events, sources, ["src_ip"]).filter(F.col("f_src_ip") != "")
    buckets = (
        rows.withColumn("_bucket", F.floor(F.unix_seconds("ts") / bucket_seconds))
        .groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("line_no", "ts")).alias("_first"))
    )
    timed = F.col("_bucket").isNotNull()
    stats = buckets.groupBy(*group).agg(
        F.count("_bucket").alias("buckets"),
        F.avg(F.when(timed, F.col("_c"))).alias("mean_per_bucket"),
        F.stddev_pop(F.when(timed, F.col("_c"))).alias("stddev_per_bucket"),
        F.coalesce(F.sum(F.when(~timed, F.col("_c"))), F.lit(0)).alias("events_without_ts"),
        # the highest count has the highest z; equal counts go to the earliest bucket
        F.max(F.when(timed, F.struct("_c", (-F.col("_bucket")).alias("_neg"), "_first"))).alias("_top"),
    )
    hits = stats.withColumns(
        {
            "bucket_count": F.col("_top._c"),
            "z": (F.col("_top._c") - F.col("mean_per_bucket")) / F.nullif(F.col("stddev_per_bucket"), F.lit(0.0)),
            "line_no": F.col("_top._first.line_no"),
            "bucket_first_ts": F.col("_top._first.ts"),
        }
    ).filter(
        (F.col("buckets") >= min_buckets)
        & (F.col("bucket_count") >= min_bucket_count)
        & (F.col("z") > z_threshold)
    )
    detail = ["bucket_count", "buckets", "mean_per_bucket", "stddev_per_bucket", "z", "events_without_ts"]
    return finding(
        hits, "web-ip-rate-spike", "src_ip", F.col("f_src_ip"), {c: F.col(c) for c in detail},
        statistical=True, ts=F.col("bucket_first_ts"),
    )


def _divergence_buckets(
    events: DataFrame, sources: DataFrame | None, key_fields: list[str], diverge_field: str, metric: str
) -> DataFrame:
    if metric not in ("bytes", "status"):
        raise ValueError("metric must be bytes or status")
    rows = _web(events, sources, [*key_fields, diverge_field, metric])
    for field in [*key_fields, diverge_field]:
        rows = rows.filter(usable(f"f_{field}"))
    number = F.col(f"f_{metric}").try_cast("double")
    keys = [f"f_{k}" for k in key_fields]
    return rows.groupBy(*SOURCE, *keys, F.col(f"f_{diverge_field}").alias("bucket")).agg(
        F.count(F.lit(1)).alias("events"), F.avg(number).alias("mean"), F.min("line_no").alias("first_line")
    )


def divergence_mean_ratio(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    key_fields: list[str] | None = None,
    diverge_field: str = "method",
    metric: str = "bytes",
    min_group_events: int = 10,
    diverge_ratio: float = 3.0,
) -> DataFrame:
    """Keys whose mean metric differs by a large factor between the values of another field."""
    if diverge_ratio <= 1:
        raise ValueError("diverge_ratio must be above 1")
    key_fields = key_fields or ["path", "src_ip", "ua"]
    keys = [f"f_{k}" for k in key_fields]
    buckets = _divergence_buckets(events, sources, key_fields, diverge_field, metric)
    stats = buckets.groupBy(*SOURCE, *keys).agg(
        F.sum("events").alias("total_events"),
        F.count("mean").alias("buckets"),
        F.min("mean").alias("lowest_mean"),
        F.max("mean").alias("highest_mean"),
        F.min("first_line").alias("line_no"),
    )
    low, high = F.col("lowest_mean"), F.col("highest_mean")
    endless = (low <= 0) & (high > 0)
    ratio = F.when(low > 0, high / low)
    hits = stats.withColumns({"ratio": ratio, "infinite": endless}).filter(
        (F.col("total_events") >= max(2, min_group_events))
        & (F.col("buckets") >= 2)
        & (F.col("infinite") | (F.col("ratio") >= diverge_ratio))
    )
    shown = F.when(F.col("infinite"), "∞").otherwise(
        F.concat(F.lit("×"), F.format_string("%.1f", F.col("ratio")))
    )
    return finding(
        hits, "web-key-divergence", diverge_field, shown,
        {
            "key": key_text(key_fields),
            **{c: F.col(c) for c in ("ratio", "total_events", "buckets", "lowest_mean", "highest_mean")},
        },
        statistical=True,
    )


def divergence_bucket_rows(
    events: DataFrame, sources: DataFrame | None = None, *, key_fields: list[str] | None = None,
    diverge_field: str = "method", metric: str = "bytes", **limits: float,
) -> DataFrame:
    """One row per compared bucket of every reported key (the long form of the finding's evidence)."""
    key_fields = key_fields or ["path", "src_ip", "ua"]
    found = divergence_mean_ratio(
        events, sources, key_fields=key_fields, diverge_field=diverge_field, metric=metric, **limits
    ).select(*SOURCE, "key")
    buckets = _divergence_buckets(events, sources, key_fields, diverge_field, metric)
    return (
        buckets.filter(F.col("mean").isNotNull())
        .select(*SOURCE, key_text(key_fields).alias("key"), "bucket", "events", "mean")
        .join(found, [*SOURCE, "key"], "left_semi")
    )


def _values_of_keys(events: DataFrame, sources: DataFrame | None, key_fields: list[str], dimension: str) -> DataFrame:
    """Values of a dimension seen with each key, with their events and last line."""
    rows = _web(events, sources, [*key_fields, dimension])
    for field in [*key_fields, dimension]:
        rows = rows.filter(usable(f"f_{field}"))
    keys = [f"f_{k}" for k in key_fields]
    return rows.groupBy(*SOURCE, *keys, F.col(f"f_{dimension}").alias("_value")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("line_no").alias("_last")
    )


def divergence_values(
    events: DataFrame, sources: DataFrame | None = None, *, key_fields: list[str] | None = None, dimension: str = "ua",
    min_distinct: int = 50,
) -> DataFrame:
    """Every value of the keys that :func:`divergence_distinct` finds, with its number of events."""
    keys = [f"f_{k}" for k in key_fields or ["src_ip"]]
    pairs = _values_of_keys(events, sources, key_fields or ["src_ip"], dimension)
    found = pairs.groupBy(*SOURCE, *keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(2, min_distinct))
    return pairs.join(found.drop("_n"), [*SOURCE, *keys], "left_semi").select(
        *SOURCE, key_text(key_fields or ["src_ip"]).alias("key"), F.col("_value").alias("value"), F.col("_c").alias("events")
    )


def divergence_distinct(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    key_fields: list[str] | None = None,
    dimension: str = "ua",
    min_distinct: int = 50,
    samples: int = 10,
) -> DataFrame:
    """Keys seen with many different values of one dimension; samples are the smallest values.

    All values of the found keys are in :func:`divergence_values`.
    """
    key_fields = key_fields or ["src_ip"]
    keys = [f"f_{k}" for k in key_fields]
    pairs = _values_of_keys(events, sources, key_fields, dimension)
    stats = pairs.groupBy(*SOURCE, *keys).agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("_c").alias("total_events"),
        F.max("_last").alias("line_no"),
    ).filter(F.col("distinct_values") >= max(2, min_distinct))
    # a rank limit is applied before the shuffle, so a key with endless values stays small
    ranked = Window.partitionBy(*SOURCE, *keys).orderBy("_value")
    sampled = (
        pairs.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= samples)
        .groupBy(*SOURCE, *keys)
        .agg(F.array_sort(F.collect_list("_value")).alias("value_samples"))
    )
    hits = stats.join(sampled, [*SOURCE, *keys])
    return finding(
        hits, "web-key-divergence", ",".join(key_fields), key_text(key_fields),
        {
            "dimension": F.lit(dimension),
            **{c: F.col(c) for c in ("distinct_values", "total_events", "value_samples")},
        },
        statistical=True,
    )


def key_divergence(events: DataFrame, sources: DataFrame | None = None, **params: object) -> DataFrame:
    """Mean-ratio mode when ``diverge_field`` is given, distinct-value mode otherwise."""
    mode = divergence_mean_ratio if "diverge_field" in params else divergence_distinct
    return mode(events, sources, **params)  # type: ignore[arg-type]


def excluded_value(value: Column, patterns: list[str], tokens: list[str]) -> Column:
    """Matches one of the patterns, or contains one of the lower-case tokens (one regex each)."""
    tests = []
    if patterns:
        tests.append(value.rlike("|".join(f"(?:{p})" for p in patterns)))
    if tokens:
        tests.append(F.lower(value).rlike("|".join(re.escape(t) for t in tokens)))
    return F.lit(False) if not tests else tests[0] if len(tests) == 1 else tests[0] | tests[1]


def cross_key_same_value(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    value_field: str = "ua",
    key_field: str = "src_ip",
    min_keys: int = 3,
    max_df: int = 5,
    exclude_value_patterns: list[str] | None = None,
    exclude_tokens: list[str] | None = None,
) -> DataFrame:
    """Rare values shared by several keys, over all sources of a case together."""
    patterns = BROWSER_UA_PATTERNS if exclude_value_patterns is None else exclude_value_patterns
    tokens = COMMON_UA_TOKENS if exclude_tokens is None else exclude_tokens
    value, key = F.col(f"f_{value_field}"), F.col(f"f_{key_field}")
    rows = _web(events, sources, [value_field, key_field]).filter(
        usable(f"f_{value_field}") & (key != "") & ~excluded_value(value, patterns, tokens)
    )
    pairs = rows.groupBy("case_id", value.alias("value"), key.alias("_key")).agg(
        F.count(F.lit(1)).alias("_c"), F.min(F.struct("source_id", "line_no")).alias("_first")
    )
    stats = pairs.groupBy("case_id", "value").agg(
        F.count(F.lit(1)).alias("key_count"),
        F.sum("_c").alias("df"),
        F.min("_first").alias("_first"),
    ).filter((F.col("key_count") >= max(2, min_keys)) & (F.col("df") <= max_df))
    # only values seen at most max_df times are left, so a key list has at most max_df entries
    listed = (
        pairs.join(stats.select("case_id", "value"), ["case_id", "value"], "left_semi")
        .groupBy("case_id", "value")
        .agg(F.array_sort(F.collect_list("_key")).alias("keys"))
    )
    hits = stats.join(listed, ["case_id", "value"]).select("*", "_first.source_id", "_first.line_no")
    return finding(
        hits, "web-cross-key-same-value", value_field, F.col("value"),
        {c: F.col(c) for c in ("key_count", "keys", "df")},
        points=F.col("key_count"), linked=True,
    )


def _far_from_median(
    events: DataFrame, sources: DataFrame | None, key_fields: list[str], bytes_field: str, ratio: float, min_samples: int
) -> DataFrame:
    ratio, min_samples = max(1.5, ratio), max(3, min_samples)
    group = [*SOURCE, *[f"f_{k}" for k in key_fields]]
    rows = _web(events, sources, [*key_fields, bytes_field])
    for field in key_fields:
        rows = rows.filter(usable(f"f_{field}"))
    rows = rows.withColumn("_v", F.col(f"f_{bytes_field}").try_cast("double")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    ).select(*group, "line_no", "_v")
    medians = exact_median(rows, group, "_v").filter((F.col("n") >= min_samples) & (F.col("median") > 0))
    return rows.join(medians, group).filter((F.col("_v") > F.col("median") * ratio) | (F.col("_v") < F.col("median") / ratio))


def size_outlier_rows(
    events: DataFrame, sources: DataFrame | None = None, *, key_fields: list[str] | None = None, bytes_field: str = "bytes",
    ratio: float = 3.0, min_samples: int = 10,
) -> DataFrame:
    """Every response far from the median size of its key."""
    key_fields = key_fields or ["path"]
    return _far_from_median(events, sources, key_fields, bytes_field, ratio, min_samples).select(
        *SOURCE, key_text(key_fields).alias("key"), "line_no", F.col("_v").alias("bytes"), F.col("median").alias("median_bytes")
    )


def size_outlier(
    events: DataFrame,
    sources: DataFrame | None = None,
    *,
    key_fields: list[str] | None = None,
    bytes_field: str = "bytes",
    ratio: float = 3.0,
    min_samples: int = 10,
    max_outliers: int = 3,
) -> DataFrame:
    """Responses far from the exact median size of their key; one finding per key.

    A finding shows the ``max_outliers`` farthest; all of them are in :func:`size_outlier_rows`.
    """
    key_fields = key_fields or ["path"]
    max_outliers = max(1, max_outliers)
    group = [*SOURCE, *[f"f_{k}" for k in key_fields]]
    flagged = _far_from_median(events, sources, key_fields, bytes_field, ratio, min_samples).withColumn(
        "_dev", F.abs(F.col("_v") - F.col("median"))
    )
    counts = flagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("outlier_count"),
        F.first("n").alias("samples"),
        F.first("median").alias("median_bytes"),
    )
    ranked = Window.partitionBy(*group).orderBy(F.col("_dev").desc(), "line_no")
    top = (
        flagged.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= max_outliers)
        .groupBy(*group)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("_rank").alias("rank"),
                        "line_no",
                        F.col("_v").alias("bytes"),
                        (F.col("_v") / F.col("median")).alias("ratio"),
                        F.when(F.col("_v") < F.col("median"), "smaller").otherwise("larger").alias("direction"),
                    )
                )
            ).alias("outliers")
        )
    )
    hits = counts.join(top, group).withColumn("line_no", F.get(F.col("outliers"), F.lit(0)).getField("line_no"))
    return finding(
        hits, "web-outlier", ",".join(key_fields), key_text(key_fields),
        {c: F.col(c) for c in ("median_bytes", "samples", "outlier_count", "outliers")},
        statistical=True,
    )
