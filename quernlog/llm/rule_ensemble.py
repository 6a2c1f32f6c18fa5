"""Quality classifier as a sparse ensemble of rules, compiled into Spark expressions.

Small regression trees are grown one after the other on the statistics of labelled documents, each on what the ones
before left over.  Every path from a root is a rule, a conjunction of comparisons.  A logistic model with lasso penalty
weighs the rules; those with weight 0 go.  The rest becomes one Spark expression, so scoring is a single scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.llm.native import text_of, words

#: At most so many labelled documents (statistics only, no text) are collected for learning.
LEARNING_ROWS = 20_000
TREES = 40
DEPTH = 3
PENALTY = 0.002
#: Score from which a document counts as good.
GOOD = 0.7

#: Conjunctions of (statistic, is above, bound).
Rule = tuple[tuple[str, bool, float], ...]
STATISTICS = (
    "n_words", "word_length", "distinct_words", "symbols_per_word", "exclamations_per_word", "capitals_per_letter",
    "stops_per_word", "digits_per_letter", "line_words", "repeated_lines", "longest_word",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the statistics and drops the text; a null text counts as empty, for which every statistic is 0.

    Texts are measured whole; repeated rows get equal statistics; an empty table gives none.  Other columns stay, but a
    column that has the name of a statistic gives way to it.
    """
    text = F.col("_text")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    n, letters = F.col("_n"), F.col("_chars")
    return (
        docs.withColumn("_text", text_of()).drop("text")
        .withColumns(
            {
                "_words": words(text),
                "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""),
                "_symbols": count("[#*$%&|<>]"), "_bangs": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
                "_capitals": count("[A-Z]"), "_stops": count("[.,;:?]"), "_digits": count("[0-9]"),
            }
        )
        .drop("_text")
        .withColumns({"_n": F.size("_words"), "_chars": F.length(F.array_join("_words", ""))})
        .withColumns(
            {
                "n_words": n.cast("double"),
                "word_length": ratio(letters, n),
                "distinct_words": ratio(F.size(F.array_distinct("_words")), n),
                "symbols_per_word": ratio(F.col("_symbols"), n),
                "exclamations_per_word": ratio(F.col("_bangs"), n),
                "capitals_per_letter": ratio(F.col("_capitals"), letters),
                "stops_per_word": ratio(F.col("_stops"), n),
                "digits_per_letter": ratio(F.col("_digits"), letters),
                "line_words": ratio(n, F.size("_lines")),
                "repeated_lines": ratio(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")),
                "longest_word": F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)).cast("double"),
            }
        )
        .drop("_words", "_lines", "_symbols", "_bangs", "_capitals", "_stops", "_digits", "_n", "_chars")
    )


def _grow(x: np.ndarray, left: np.ndarray, rows: np.ndarray, depth: int, features: np.ndarray, path: Rule, out: list[tuple[Rule, float]]) -> None:
    """Adds the paths of a least-squares tree below ``path`` with the mean of what is left over there."""
    if path:
        out.append((path, float(left[rows].mean())))
    if depth == 0 or len(rows) < 20:
        return
    best, split = 1e-9, None
    total, n = left[rows].sum(), len(rows)
    for f in features:
        order = rows[np.argsort(x[rows, f], kind="stable")]
        values = x[order, f]
        sums = np.cumsum(left[order])[:-1]
        k = np.arange(1, n)
        gain = sums**2 / k + (total - sums) ** 2 / (n - k) - total**2 / n
        gain[(values[1:] == values[:-1]) | (k < 5) | (n - k < 5)] = 0
        at = int(gain.argmax()) if n > 1 else 0
        if n > 1 and gain[at] > best:
            best, split = float(gain[at]), (int(f), float((values[at] + values[at + 1]) / 2))
    if split is None:
        return
    f, bound = split
    above = x[rows, f] > bound
    for side in (False, True):
        _grow(x, left, rows[above == side], depth - 1, features, (*path, (STATISTICS[f], side, bound)), out)


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, side, bound in rule:
        hit &= (x[:, STATISTICS.index(name)] > bound) == side
    return hit


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, side, bound in rule:
                holds = holds & ((F.col(name) > bound) if side else (F.col(name) <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    """Rules and weights from statistics and labels (0 or 1).  One class only, or no row, gives a constant score."""
    if len(y) == 0 or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), [])
    random = np.random.default_rng(seed)
    score, paths = np.zeros(len(y)), {}
    for _ in range(TREES):
        left = y - 1 / (1 + np.exp(-score))
        rows = np.sort(random.permutation(len(y))[: max(20, len(y) * 2 // 3)])
        features = np.sort(random.permutation(len(STATISTICS))[: max(3, len(STATISTICS) * 2 // 3)])
        grown: list[tuple[Rule, float]] = []
        _grow(x, left, rows, DEPTH, features, (), grown)
        for rule, value in grown:
            paths.setdefault(tuple(sorted(rule)), None)
            score += np.where(_covers(rule, x), 0.5 * value, 0)
    rules = list(paths)
    hits = np.stack([_covers(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    hits, keep = np.unique(hits, axis=1, return_index=True)
    rules = [rules[i] for i in keep]
    # lasso by accelerated proximal gradient steps
    step = 4.0 / max(1.0, np.linalg.norm(np.c_[np.ones(len(y)), hits], 2) ** 2 / len(y))
    weights = np.zeros(len(rules) + 1)
    ahead, pace = weights.copy(), 1.0
    for _ in range(1500):
        p = 1 / (1 + np.exp(-(ahead[0] + hits @ ahead[1:])))
        slope = np.r_[(p - y).mean(), hits.T @ (p - y) / len(y)]
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, weights, pace = new + (pace - 1) / following * (new - weights), new, following
    return Ensemble(float(weights[0]), [(r, float(w)) for r, w in zip(rules, weights[1:]) if w != 0])


def learning_rows(statistics: DataFrame, labels: DataFrame, label: str = "quality", most: int = LEARNING_ROWS) -> DataFrame:
    """(statistics, _label), one row for each of at most ``most`` labelled doc_ids, chosen by a bound on their hash.

    Null labels are left out.  A doc_id with several labels takes the largest, one with several rows the smallest of them.
    """
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    wanted = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    n = wanted.count()
    if n > most:  # expects most rows less six standard deviations, so that more than most never come
        wanted = wanted.filter(part < int((most - 6 * most**0.5) / n * (1 << 20)))
    rows = statistics.join(wanted, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS, "_label")).alias("_row"))
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").select("_row.*")


def fit(statistics: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    """Learns from :func:`learning_rows`; no such row gives a constant score."""
    rows = learning_rows(statistics, labels, label).toArrow()
    x = np.array([rows[s].to_numpy() for s in STATISTICS], float).reshape(len(STATISTICS), rows.num_rows).T.copy()
    return learn(x, rows["_label"].to_numpy().astype(float))


def score(statistics: DataFrame, ensemble: Ensemble) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from GOOD on), in place of columns of these names; one row for each row."""
    return statistics.withColumn("score", ensemble.column()).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
