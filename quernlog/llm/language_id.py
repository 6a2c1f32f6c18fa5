"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its character n-grams (two to four characters inside a word, its borders
included), hashed into a fixed number of buckets; a linear layer on the mean gives the languages.  Both are trained by
stochastic gradient descent in numpy.  As both are linear, one table of bucket by language scores texts.

Probabilities are calibrated with one temperature on rows kept out of training and on short cuts of them, which are told
less surely than whole texts.  A text is rejected where the log-odds of its language are too low.  The bound is learnt from
languages that are left out of training, a group at a time: what is left in is told apart, what is left out has to go.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.llm.arrow import map_texts
from quernlog.llm.textarrays import code_points, mix64

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
#: Learning rows of a language come in so many parts by hash, and from each part at most so many rows are collected,
#: each at most BUCKETS pairs of numbers.
PARTS, ROWS_PER_PART = 16, 75
EPOCHS = 12
BATCH = 32
RATE = 60.0
#: Code points of the cut from the middle of a text that calibrates besides the whole text.
CUT = 60
#: Languages are left out in so many groups to learn the rejection bound.
LEFT_OUT_GROUPS = 4
#: The bound rejects this share of the left-out texts if it can, but of the rightly told ones never more than the second share.
FOREIGN, REJECTED = 0.95, 0.004
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams in the order of their first character, BUCKETS where a place has none; text of each place."""
    lowered = [t.lower() for t in texts]
    points = code_points("".join(f"\n{t}\n" for t in lowered))  # a border of its own on each side of a text
    owner = np.repeat(np.arange(len(lowered)), [len(t) + 2 for t in lowered])
    kept = np.where(_letters()[points], points, 0).astype(np.uint64)
    runs = np.ones(len(kept), bool)
    runs[1:] = (kept[1:] != 0) | (kept[:-1] != 0) | (owner[1:] != owner[:-1])
    kept, owner = kept[runs], owner[runs]
    c = np.concatenate((kept, np.zeros(3, np.uint64)))
    n = len(kept)
    inner = c != 0
    grams = []
    value = c[:n]
    sound = np.ones(n, bool)
    for k in (1, 2, 3):
        value = value * np.uint64(0x9E3779B97F4A7C15) + c[k : n + k] + np.uint64(k)
        if k > 1:
            sound = sound & inner[k - 1 : n + k - 1]
        else:
            sound = inner[:n] | inner[1 : n + 1]
        bucket = (mix64(value) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        grams.append(np.where(sound, bucket, BUCKETS))
    return np.stack(grams, axis=1), owner


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket by language, a last row of zeros
    bias: np.ndarray
    temperature: float
    threshold: float  # of the log-odds

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (``und`` without a letter), calibrated probability (0 without a letter) and whether it is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        grams, owner = subwords(texts)
        starts = np.searchsorted(owner, np.arange(len(texts)))
        per_place = self.table[grams[:, 0]] + self.table[grams[:, 1]] + self.table[grams[:, 2]]
        sums = np.add.reduceat(per_place, starts, axis=0) if len(texts) else np.zeros((0, len(self.languages) + 1))
        counts = sums[:, -1]
        logits = (sums[:, :-1] / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        p = softmax(logits)
        best = p.argmax(axis=1)
        known = counts > 0
        return (
            [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
            np.where(known, p.max(axis=1), 0.0),
            ~known | (odds(logits) < self.threshold),
        )


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def odds(logits: np.ndarray) -> np.ndarray:
    """Log-odds of the likeliest language against all others; 0 where there are no others."""
    if logits.shape[1] < 2:
        return np.zeros(len(logits))
    order = np.sort(logits, axis=1)
    rest = order[:, :-1]
    return order[:, -1] - rest[:, -1] - np.log(np.exp(rest - rest[:, -1:]).sum(axis=1))


def fold(key: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def learning_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """Bucket shares of whole texts and of cuts of the bounded sample: the rows with the smallest hashes of each part."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out & F.col("text").rlike("\\p{L}"))
    usable = usable.withColumns({"key": key, "part": F.pmod(F.xxhash64(F.lit(1), key), F.lit(PARTS)).cast("int")})
    first = Window.partitionBy("lang", "part").orderBy("key", "doc_id")
    bounds = (
        usable.select("lang", "part", "doc_id", "key")
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= ROWS_PER_PART)
        .groupBy("lang", "part")
        .agg(F.max("key").alias("last"))
        .collect()  # one row per language and part
    )
    last = docs.sparkSession.createDataFrame([tuple(r) for r in bounds], "lang string, part int, last long")

    def start() -> Callable[[list[str]], dict[str, list]]:
        def run(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"buckets": [], "shares": [], "cut_buckets": [], "cut_shares": []}
            for t in texts:
                begin = max(0, len(t) - CUT) // 2
                for prefix, part in (("", t), ("cut_", t[begin : begin + CUT])):
                    found, n = np.unique(subwords([part])[0], return_counts=True)
                    found, n = found[found < BUCKETS], n[found < BUCKETS]
                    out[prefix + "buckets"].append(found.astype(np.int16))
                    out[prefix + "shares"].append((n / max(1, n.sum())).astype(np.float32))
            return out

        return run

    chosen_docs = usable.join(F.broadcast(last), ["lang", "part"]).filter("key <= last").select("doc_id", "lang", "text")
    return map_texts(chosen_docs, ["doc_id", "lang"], "buckets array<smallint>, shares array<float>, cut_buckets array<smallint>, cut_shares array<float>", start)


@dataclass
class _Rows:
    """Bucket shares of texts: those of a text lie together, the texts in any order."""

    starts: np.ndarray
    ends: np.ndarray
    buckets: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, buckets: pa.Array, shares: pa.Array, order: np.ndarray) -> _Rows:
        """The texts ``order`` of the columns, whose numbers are read where they are."""
        borders = buckets.offsets.to_numpy().astype(np.int64)
        borders = borders - borders[0]
        return cls(borders[:-1][order], borders[1:][order], buckets.flatten().to_numpy(), shares.flatten().to_numpy())

    def dense(self, at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), BUCKETS), np.float32)
        for i, row in enumerate(at):
            part = slice(self.starts[row], self.ends[row])
            x[i, self.buckets[part]] = self.shares[part]
        return x

    def logits(self, at: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
        parts = np.array_split(at, max(1, len(at) // 256))
        return np.concatenate([self.dense(p).astype(float) @ table + bias for p in parts])


def _trained(x: _Rows, y: np.ndarray, rows: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Table of bucket by language and bias, by stochastic gradient descent."""
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = random.normal(0, 0.1, (DIMENSIONS, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)
    hot = np.eye(n, dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(random.permutation(rows), max(1, len(rows) // BATCH)):
            part = x.dense(at)
            v = part @ embed
            error = (softmax(v @ linear + bias) - hot[y[at]]) / len(at)
            back = error @ linear.T
            linear -= 0.02 * rate * (v.T @ error)
            bias -= 0.001 * rate * error.sum(axis=0)
            embed -= rate * (part.T @ back)
    return embed.astype(float) @ linear.astype(float), bias.astype(float)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The one under which the true languages are likeliest."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    return float(min(np.geomspace(0.05, 20, 60), key=loss))


def fit(docs: DataFrame, held_out: Column, seed: int = 7) -> Model:
    """Learns from rows with a language that ``held_out`` does not hold for; a fifth of them calibrates.

    Without such rows the model knows no language and answers ``und`` for every text.  With one or two languages there is
    nothing to leave out, and only the log-odds of rightly told rows bound the rejection.
    """
    rows = learning_rows(docs.select("doc_id", "lang", "text"), held_out).toArrow()  # numbers stay in arrays
    found = rows["lang"].to_pylist()
    by_id = sorted(range(rows.num_rows), key=list(zip(map(str, rows["doc_id"].to_pylist()), found)).__getitem__)
    found = [found[i] for i in by_id]
    languages = sorted(set(found))
    if not found:
        return Model([], np.zeros((BUCKETS + 1, 1)), np.zeros(0), 1.0, 0.0)
    whole, cut = (_Rows.of(*(rows[f"{p}{c}"].combine_chunks() for c in ("buckets", "shares")), np.array(by_id)) for p in ("", "cut_"))
    del rows
    y = np.array([languages.index(f) for f in found])
    order = np.random.default_rng(seed).permutation(len(y))
    calibrating, training = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 20 else (order, order)

    def learnt(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Table, bias and temperature of a model of the languages ``kept``, by their numbers."""
        number = np.full(len(languages), -1)
        number[kept] = np.arange(len(kept))
        mine = number[y]
        table, bias = _trained(whole, mine, training[mine[training] >= 0], len(kept), seed)
        at = calibrating[mine[calibrating] >= 0]
        logits = np.concatenate([x.logits(at, table, bias) for x in (whole, cut)])
        return table, bias, _temperature(logits, np.tile(mine[at], 2)) if len(at) else 1.0

    every = np.arange(len(languages))
    table, bias, temperature = learnt(every)
    logits = whole.logits(calibrating, table, bias) / temperature
    right = np.sort(odds(logits)[logits.argmax(axis=1) == y[calibrating]])
    threshold = float(right[int(REJECTED * len(right))]) if len(right) else 0.0
    if len(languages) > 2:
        foreign = []
        for group in range(min(LEFT_OUT_GROUPS, len(languages))):
            out = every % min(LEFT_OUT_GROUPS, len(languages)) == group
            at = calibrating[out[y[calibrating]]]
            if len(at):
                part, shift, t = learnt(every[~out])
                foreign.append(odds(whole.logits(at, part, shift) / t))
        if foreign:
            threshold = min(threshold, float(np.quantile(np.concatenate(foreign), FOREIGN)))
    padded = np.zeros((BUCKETS + 1, len(languages) + 1))
    padded[:BUCKETS, :-1] = table
    padded[:BUCKETS, -1] = 1
    return Model(languages, padded, bias, temperature, threshold)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and rejected.

    Null texts and texts without a letter are ``und`` with score 0 and are rejected; texts are read whole, whatever
    their length; repeated rows get equal results; an empty table gives none.
    """

    def start() -> Callable[[list[str]], dict[str, list]]:
        def run(texts: list[str]) -> dict[str, list]:
            found, score, rejected = model.score(texts)
            return {"lang_pred": found, "score": score, "rejected": rejected}

        return run

    return map_texts(docs, keep, "lang_pred string, score double, rejected boolean", start)
