"""Quality rules kept as a ledger: measurements and failure bits once, policies and ablations afterwards.

``ledger`` evaluates every rule on every document in one scan without a shuffle and stores one bit per failed rule.
A policy is a named, versioned mask of rules.  Applying it, or asking what a rule changes, never reads texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.llm.native import indices, let, text_of, words

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Low bits of a packed window that hold its place; Spark's own row size ends before 2**28 words.  Both are powers of two.
_PLACE_BITS = 28
_PLACES, _HASHES = 1 << _PLACE_BITS, 1 << 35


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` holds; ``fails`` is SQL over the measurements, in whole numbers."""

    name: str
    fails: str


#: The place of a rule is its bit and never changes; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("exclamations", "100 * n_exclamations > 20 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that a document must pass.
POLICIES = {
    "base-1": BASE,
    "strict-1": tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...]) -> int:
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[n] for n in names)


def packed(hashed: Column, place: Column) -> Column:
    """Hash and place in one long, never null, so that arrays of them are sorted as plain numbers."""
    return F.shiftleft(hashed.bitwiseAND(F.lit(_HASHES - 1)), _PLACE_BITS).bitwiseOR(place.cast("long"))


def place_of(window: Column) -> Column:
    return window.bitwiseAND(F.lit(_PLACES - 1))


def one_hash(a: Column, b: Column) -> Column:
    """Whether two packed windows differ in their places alone."""
    return a.bitwiseXOR(b) < F.lit(_PLACES)


def of_shared_hashes(order: str) -> Column:
    """Of sorted packed windows those whose hash another one has, in that order.

    Most texts have none, which the number of distinct hashes tells without looking at neighbours.
    """
    windows, size = F.col(order), F.size(order)
    hashes = F.transform(windows, lambda v: F.shiftright(v, _PLACE_BITS))

    def has_neighbour(v: Column, i: Column) -> Column:
        return ((i > 0) & one_hash(windows[i - 1], v)) | ((i < size - 1) & one_hash(v, windows[i + 1]))

    return F.when(F.size(F.array_distinct(hashes)) == size, F.array().cast("array<bigint>")).otherwise(F.filter(windows, has_neighbour))


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the measurements as columns.

    Null text counts as empty: every count is 0.  Texts of any length are measured whole.  Windows of three words are
    sorted by a hash with their place in the low bits.  Only windows whose hash occurs again are compared word by word,
    with their neighbours first; where different windows share a hash, all of these are compared, so counts are exact.
    A row's work stays in that row.
    """
    text = F.col("_text")
    w, shared, size = F.col("_words"), F.col("_shared"), F.size("_shared")

    def same(a: Column, b: Column) -> Column:
        """The hash settles nearly every pair, the words the rest."""
        i, j = place_of(a).cast("int"), place_of(b).cast("int")
        return one_hash(a, b) & (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

    def repeated(v: Column, i: Column) -> Column:
        before, after = shared[i - 1], shared[i + 1]
        beside = ((i > 0) & same(before, v)) | ((i < size - 1) & same(v, after))
        # every window here has another one of its hash: where no neighbour is equal, an equal one may stand behind them
        return beside | F.exists(shared, lambda u: (u != v) & same(u, v))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    first = docs.withColumn("_text", text_of()).drop("text")
    return (
        first.withColumns(
            {
                "_words": words(text),
                "_lines": lines,
                "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
                "n_exclamations": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
                "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            }
        )
        .drop("_text")
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            }
        )
        .drop("_lines")
        .withColumns(
            {
                "_order": F.sort_array(
                    let(
                        w,
                        lambda v: F.transform(
                            indices(F.col("n_words").cast("int") - 2),
                            lambda i: packed(F.xxhash64(v[i], v[i + 1], v[i + 2]), i),
                        ),
                    )
                ),
            }
        )
        .withColumn("_shared", of_shared_hashes("_order"))
        .drop("_order")
        .withColumn("_places", F.sort_array(F.transform(F.filter(shared, repeated), place_of)))
        .drop("_words", "_shared")
        .withColumn(
            "n_repeat_words",
            F.aggregate(
                F.transform(
                    "_places",
                    lambda p, i: F.when(
                        i < F.size("_places") - 1, F.least(F.lit(3).cast("long"), F.col("_places")[i + 1] - p)
                    ).otherwise(F.lit(3).cast("long")),
                ),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )
        .drop("_places")
    )


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals",
)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: its doc_id, the measurements and ``fail_bits``.

    Null or empty texts fail ``few_words`` and nothing else.  Repeated rows are judged each on their own; an empty
    table gives an empty ledger; other columns of ``docs`` are left out, so their names cannot clash.
    """
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return with_measures(docs.select("doc_id", "text")).select("doc_id", *MEASURES, bits.alias("fail_bits"))


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds ``kept``: whether no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: how many documents fail it, how many only it drops, and how many stay without it.

    Documents are first counted by their bits, so at most two to the number of rules rows are worked on.
    """
    chosen = mask(POLICIES[version])
    by_bits = (
        rows.select(F.col("fail_bits").bitwiseAND(F.lit(chosen).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    )
    names = {i: r.name for i, r in enumerate(RULES) if r.name in POLICIES[version]}
    table = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(n).alias("rule")) for i, n in names.items()])
    return (
        by_bits.select("bits", "n", F.explode(table).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
