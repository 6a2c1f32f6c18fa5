"""Exact and near duplicates among short texts, decided in creation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import computed_once
from quernlog.operators.similar_sets import similar
from quernlog.session import materialized

THRESHOLD = 0.85
SWEEP = (0.85, 0.7, 0.6, 0.5)
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: The first of these characters is U+1100; texts without one from there on are not searched for them.
_MAYBE_CJK = r"[\x{1100}-\x{10FFFF}]"


def normalized_text(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "")


def keywords(text: Column) -> Column:
    """Distinct ASCII words of two or more characters, and character pairs of CJK runs (single ones alone)."""
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit("[a-z0-9]{2,}"), F.lit(0))
    found = F.regexp_extract_all(lowered, F.lit(f"[{_CJK}]+"), F.lit(0))
    wide = (F.octet_length(lowered) > F.length(lowered)) & lowered.rlike(_MAYBE_CJK)
    runs = F.when(wide, found).otherwise(F.array().cast("array<string>"))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
                F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
            ),
        )
    )
    return F.array_distinct(F.concat(words, pairs))


def exact_groups(texts: DataFrame) -> DataFrame:
    """Texts that are the same after normalization: (case_id, digest, first id, copies)."""
    norm = texts.withColumn("_norm", normalized_text(F.col("text"))).filter(F.col("_norm") != "")
    return (
        norm.groupBy("case_id", F.sha2("_norm", 256).alias("digest"))
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def _representatives(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, reps, rows): every text with the earliest one of equal form and keywords, those earliest ones, all numbered.

    Keywords stand as sorted 64-bit hashes, in ``rows`` only, so that they are never sorted or joined as a whole.  Texts
    without a letter or digit have no representative.  A null case is a case of its own.
    """
    rows = computed_once(
        texts.select(F.struct("case_id").alias("case"), "id", "text"),
        {"norm": normalized_text(F.col("text")), "kw": F.sort_array(F.transform(keywords(F.col("text")), lambda k: F.xxhash64(k)))},
    )
    rows = rows.select("case", "id", "kw", F.when(F.col("norm") != "", F.unhex(F.sha2("norm", 256))).alias("norm"))
    rows = materialized(rows.select(F.monotonically_increasing_id().alias("num"), F.xxhash64(F.lit("case"), "case").alias("section"), "*"))
    form = F.when(F.col("norm").isNotNull(), F.struct("norm", F.xxhash64("kw").alias("kw")))
    small = rows.select("num", "case", "id", "norm", form.alias("form"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "num")))
    forms = materialized(small.filter("norm is not null").groupBy("case", "form").agg(first.alias("first")))
    members = materialized(
        small.select("case", "id", "form").join(forms, ["case", "form"], "left").select("case", "id", F.col("first.id").alias("rep"))
    )
    reps = forms.filter("first is not null").groupBy("case", F.col("first.id").alias("id")).agg(
        F.min(F.struct(F.col("first.num").alias("num"), F.col("form.norm").alias("norm"))).alias("one")
    )
    return members, materialized(reps.select("case", "id", "one.num", "one.norm")), rows


def links(reps: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(case, id, other, score, exact) for every two representatives, other the earlier, that are exact or similar.

    Sets of keywords that may be as similar as the threshold are found and counted by :func:`similar_sets.similar`.
    """
    score = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    found = similar(rows, reps.select("num"), threshold).select("a", "b", score.alias("score")).filter(F.col("score") >= threshold)
    # few columns, as there may be many links: the case only on one side, hashes on both
    told = F.xxhash64("case", "norm").alias("told"), F.xxhash64("case").alias("section")
    one = reps.select(F.col("num").alias("a"), "case", "id", *told)
    two = reps.select(F.col("num").alias("b"), F.col("id").alias("other"), told[0].alias("other_told"), told[1].alias("other_section"))
    named = found.join(one, "a").join(two, "b").filter("section = other_section and told <> other_told")
    near = named.select("case", F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other"), "score", F.lit(False).alias("exact"))
    shared = reps.groupBy("case", "norm").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case", "norm")
    forms = reps.select("case", "norm", "id").join(shared, ["case", "norm"], "left_semi")
    same = forms.join(forms.withColumnRenamed("id", "other"), ["case", "norm"]).filter("other < id")
    return near.union(same.select("case", "id", "other", F.lit(1.0).alias("score"), F.lit(True).alias("exact")))


def settled(texts: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Verdict per threshold and text in order of ``id``: 'exact', 'similar' or 'none' against the earlier accepted texts.

    Columns: threshold, case_id, id, verdict, blocked_by, score; the blocking text is the exact one, else the most
    similar, the earliest of equals.  One table of verified links at the lowest threshold serves all thresholds at once.
    They are settled in rounds: a text whose earlier links are all settled and blocked is accepted, one with an
    accepted earlier link is blocked.  Rounds end with the longest chain of links, not with the number of texts.
    """
    members, reps, rows = _representatives(texts)
    wanted = F.array(*[F.lit(float(t)) for t in thresholds])
    found = materialized(links(reps, rows, min(thresholds)))
    meets = F.explode(F.filter(wanted, lambda t: F.col("exact") | (F.col("score") >= t))).alias("threshold")
    key = ["threshold", "case", "id"]
    open_links = found.select(meets, "case", "id", "other")
    blocked = None
    while True:
        open_links = materialized(open_links)
        if open_links.isEmpty():
            break
        waiting = open_links.select(*key).distinct()
        leaders = open_links.select("threshold", "case", "other").distinct().join(
            waiting.withColumnRenamed("id", "other"), ["threshold", "case", "other"], "left_anti"
        )
        stopped = materialized(open_links.join(leaders, ["threshold", "case", "other"]).select(*key).distinct())
        blocked = stopped if blocked is None else blocked.union(stopped)
        rest = open_links.join(stopped, key, "left_anti")
        open_links = rest.join(stopped.withColumnRenamed("id", "other"), ["threshold", "case", "other"], "left_anti")
    every = members.select("*", F.explode(wanted).alias("threshold"))
    if blocked is None:
        blocked = every.select(*key).limit(0)
    # links of a blocked representative to accepted ones, earlier and later: its twins may stand behind those too
    either = found.select(meets, "case", F.col("id").alias("rep"), "other", "score", "exact").union(
        found.select(meets, "case", F.col("other").alias("rep"), F.col("id").alias("other"), "score", "exact")
    )
    stopped = blocked.withColumnRenamed("id", "rep")
    standing = either.join(blocked.withColumnRenamed("id", "other"), ["threshold", "case", "other"], "left_anti")
    standing = standing.join(stopped, ["threshold", "case", "rep"], "left_semi")
    best = (
        every.join(standing, ["threshold", "case", "rep"]).filter("other < id").groupBy(*key)
        .agg(F.max(F.struct("exact", "score", (-F.col("other")).alias("neg"))).alias("best"))
    )
    out = every.join(best, key, "left")
    hit, twin = F.col("best").isNotNull(), F.col("best").isNull() & (F.col("id") != F.col("rep"))
    return out.select(
        "threshold", F.col("case.case_id").alias("case_id"), "id",
        F.when(twin | (hit & F.col("best.exact")), "exact").when(hit, "similar").otherwise("none").alias("verdict"),
        F.when(hit, -F.col("best.neg")).when(twin, F.col("rep")).alias("blocked_by"),
        F.when(hit, F.col("best.score")).when(twin, 1.0).alias("score"),
    )


def replay(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(case_id, id, verdict, blocked_by, score): :func:`settled` at one threshold."""
    return settled(texts, (threshold,)).drop("threshold")


def threshold_sweep(texts: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """How many texts each threshold would block: (threshold, total, exact, similar)."""
    return settled(texts, thresholds).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "exact").alias("exact"),
        F.count_if(F.col("verdict") == "similar").alias("similar"),
    )
