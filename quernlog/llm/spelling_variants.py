"""Grouping of spelling variants: words one edit apart, found through PartEnum signatures.

A word is the set of its numbered letters (third ``e``, first ``t``): a binary vector.  One edit changes at most two
places of it, one where the length changes.  The places are dealt into ``PARTS`` parts; two near words agree on all
parts but two (but one), so each word enumerates a signature for every choice of parts to leave out.  Signatures also
hold the length and one half of the word, as one edit leaves the other half as it is; that keeps groups of equal
signatures small.  They are equi-joined and each pair that meets is verified by its edit distance inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.llm.native import Scratch, text_of
from quernlog.llm.textarrays import code_points, mix64, prefix_sums, span_hashes

#: Parts that the numbered letters are dealt into.
PARTS = 5
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a slice that is worked out at once.
SLICE = 20_000


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, word) for every maximal run of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.

    Null, empty and letterless texts give no row; equal rows give theirs each.
    """
    runs = F.regexp_extract_all(F.translate(text_of(), _UPPER, _LOWER), F.lit("([a-zÀ-ÿ]+)"))
    return docs.select("doc_id", F.explode(runs).alias("word"))


def counted(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """Distinct words of at least ``length`` code points and ``count`` rows, with their number ``n``; null is no word."""
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _signatures(words: list[str], rank: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, which word, signature): kind 0 for equal lengths, 1 as the shorter, 2 as the longer of two."""
    letters = [code_points(w) for w in words]
    sizes = np.array([len(x) for x in letters], np.int64)
    which, flat = np.repeat(np.arange(len(words)), sizes), np.concatenate(letters).astype(np.int64)
    order = np.lexsort((flat, which))
    which, flat = which[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (which[1:] != which[:-1])
    at = np.arange(len(flat))
    number = at - np.maximum.accumulate(np.where(new, at, 0))  # of the letter within its word
    kinds, inverse = np.unique(flat, return_inverse=True)
    part = (np.array([rank.get(int(k), int(k)) for k in kinds], np.int64)[inverse] + 2 * number) % PARTS
    name = mix64((flat.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (which, part), name)
    total = sums.sum(axis=1, dtype=np.uint64)
    ends = np.cumsum(sizes)
    prefixes = prefix_sums(np.concatenate(letters))

    def halves(least: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Names of the halves that two words share whose shorter one has ``least`` letters."""
        begin, half = ends - sizes, least // 2
        head = span_hashes(prefixes, begin, begin + half)
        tail = span_hashes(prefixes, ends - (least - half), ends)
        return [mix64(head + least.astype(np.uint64) * np.uint64(2)), mix64(tail + least.astype(np.uint64) * np.uint64(2) + np.uint64(1))]

    everything = np.arange(len(words))
    for half in halves(sizes, sizes):
        for i, j in combinations(range(PARTS), 2):
            yield 0, everything, mix64(mix64(total - sums[:, i] - sums[:, j] + np.uint64(PARTS * i + j)) + half)
        for i in range(PARTS):
            yield 1, everything, mix64(mix64(total - sums[:, i] + np.uint64(PARTS * PARTS + i)) + half)
    for half in halves(sizes - 1, sizes):
        for i in range(PARTS):
            yield 2, everything, mix64(mix64(total - sums[:, i] + np.uint64(PARTS * PARTS + i)) + half)


def signatures(words: DataFrame, rank: dict[int, int]) -> DataFrame:
    """(kind, signature, word, n): the enumerated signatures of every word; see :func:`_signatures`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for kind, which, found in _signatures(part.column("word").to_pylist(), rank):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(which), kind, np.int8)), pa.array(found.view(np.int64)), part.column("word"), part.column("n")],
                        ["kind", "signature", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(work, "kind byte, signature long, word string, n long")


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn) once for every two words of ``words`` (word, n) that one inserted, deleted or replaced letter tells apart."""
    spark = words.sparkSession
    # the frequent letters are dealt to different parts; as many rows as there are letters
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).groupBy("c").count()
    found = sorted(((-r["count"], r["c"]) for r in letters.collect() if r["c"]))
    rank = {ord(c): k for k, (_, c) in enumerate(found)}
    rows = Scratch(spark).stored(signatures(words, rank))

    def side(kind: int, name: str) -> DataFrame:
        return rows.filter(F.col("kind") == kind).select("signature", F.col("word").alias(name), F.col("n").alias(f"{name}n"))

    same = side(0, "a").join(side(0, "b"), "signature").filter((F.col("a") < F.col("b")) & _one_edit(F.col("a"), F.col("b")))
    longer = side(1, "a").join(side(2, "b"), "signature").filter(_one_edit(F.col("a"), F.col("b")))
    return same.union(longer).select("a", "an", "b", "bn").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of ``words`` (word, n): form, root, n, n_near, form_n.

    ``n_near`` counts the words one edit apart, the form is that of largest n (ties: smallest in code-point order) if
    its n is at least ``ratio`` (more than 1) times the word's, else null; the root is where following forms ends, the
    word itself without one.  ``words`` must hold distinct words that aren't null or empty, as :func:`counted` gives
    them; an empty table gives no rows and columns beside word and n are left out.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.stored(words.select("word", "n"))
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("is", -F.col("best.m") >= ratio * F.col("n"))
    rows = scratch.stored(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("is"), F.col("best.near")).alias("form"), F.when(F.col("is"), -F.col("best.m")).alias("form_n"),
        )
    )
    # n grows along forms, so they end; each round doubles the steps taken
    roots = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.stored(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
