"""Cross-entropy difference of two matched bigram models.

Target and background model share one vocabulary, all words of the corpus, and one smoothing; the background's counts are
scaled to the size of the target, so neither is the sharper for having seen more.  A document's score is its mean loss per
word under the target model less that under the background model: the lower, the more it reads like the target.

A model that has seen a document knows it too well, so each half of the documents is scored by the models counted on the
other half.  Counts cover all documents, all words and all bigrams; words and bigrams are named by 64-bit hashes.  They
stay a Spark table, grouped by ranges of the hashes.  A chunk of documents asks each range once for the words and bigrams
that it holds, whatever their number in the chunk, and gets their counts back.  Hashes and counts travel as sorted arrays
of a range, about 6 bytes for each, not as rows of 20 bytes and more.

The loss of a word x after v is -log((c(v, x) + W u(x)) / (c(v) + W)), taken as -log(W u(x)), plus log(c(v) + W), less
log(1 + c(v, x) / (W u(x))).  So a bigram that one half alone has seen changes nothing and its count can go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quernlog.llm.arrow import slices
from quernlog.llm.native import Scratch, text_of
from quernlog.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from quernlog.llm.textarrays import begins, byte_words, distinct, mix64, numbered

#: Bytes of text for each range of the hashes, and of a chunk of documents scored together; matters of memory and speed alone.
RANGE, CHUNK = 16_000_000, 8_000_000
#: Most bits of the filter of target documents; where there are more than a sixteenth as many, more texts are moved in vain.
FILTER_BITS = 1 << 26
#: Words counted in a task before their counts go out.
HELD = 2_000_000
#: Weight of the unigram model in words seen, and of the uniform model in the unigram one.
UNIGRAM_WEIGHT, UNIFORM_WEIGHT = 8.0, 1.0
#: Stands before the first word of a text.
BEGIN = np.uint64(0x5851F42D4C957F2D)
#: By half, then target and all documents.
COUNTS = ["c0", "c1", "c2", "c3"]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_BLOCKS = "part int, pair boolean, keys binary, " + ", ".join(f"{c} binary" for c in COUNTS)
_TABLE = _BLOCKS + ", words long, " + ", ".join(f"n{i} long" for i in range(4))
_ASKING = "chunk int, part int, pair boolean, keys binary"
_ANSWERS = "chunk int, part int, pair boolean, found binary, target binary, background binary"
#: Frees the files of the exchanges of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, bigrams of each with the word before it, where a text begins, and the text of each word."""
    words, sizes = byte_words(texts.cast(pa.binary()).to_pylist())
    first = np.zeros(len(words), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.where(first, BEGIN, np.roll(words, 1))
    pairs = mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(words))
    return words, np.maximum(pairs, np.uint64(1)), first, np.repeat(np.arange(len(sizes)), sizes)


def half(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(2)).cast("int")


def _tallied(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts of the held words, then of the bigrams, each in order of their hashes.

    What is held is given free: only sorted copies and runs are in memory.
    """
    word, pair, kind = (np.concatenate(x) for x in zip(*held))
    held.clear()
    parts = [tuple(x[mine] for x in (word, pair, kind)) for mine in (pair == 0, pair != 0)]
    del word, pair, kind
    while parts:
        yield from _runs(*parts.pop(0))


def _runs(word: np.ndarray, pair: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of words alone or of bigrams alone, by word and pair."""
    bigrams = pair.any()
    order = np.argsort(pair if bigrams else word)
    word, pair, kind = word[order], pair[order], kind[order]
    if bigrams and (begins(word) & ~begins(pair)).any():  # words that share the hash of a bigram
        order = np.lexsort((word, pair))
        word, pair, kind = word[order], pair[order], kind[order]
    del order
    new = begins(word) | begins(pair)
    key = np.cumsum(new, dtype=np.int32) - 1
    word, pair = word[new], pair[new]
    n = np.bincount(4 * key + kind, minlength=4 * len(word)).reshape(-1, 4)
    del key, new
    seen = n[:, 1], n[:, 0] + n[:, 1], n[:, 3], n[:, 2] + n[:, 3]
    for i in range(0, len(word), 100_000):
        part = slice(i, i + 100_000)
        arrays = [pa.array(x[part].astype(np.int64)) for x in (word, pair, *seen)]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "pair", *COUNTS])


def _pieces(docs: DataFrame, size: int) -> int:
    """How many pieces of ``size`` bytes the texts make, at least 1."""
    return 1 + (docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0) // size


def _rows(made: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*made) if made else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[kind]) for x, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The ranges of the hashes that occur in sorted ``keys``, with their place there."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(part[start]), slice(start, end)


def _packed_counts(tallied: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple]:
    """(part, pair, keys, c0 .. c3) of the counts of a task, which are in order; words and bigrams apart."""
    parts_of = []
    for b in tallied:
        word, pair, *counts = (c.to_numpy() for c in b.columns)
        parts_of.append((np.where(pair == 0, word, pair).view(np.uint64), pair != 0, *(c.astype(np.int32) for c in counts)))
    if not parts_of:
        return
    keys, pairs, *counts = (np.concatenate(x) for x in zip(*parts_of))
    parts_of.clear()
    for kind in (False, True):
        mine, *n = (x[pairs == kind] for x in (keys, *counts))
        for part, at in _ranges(mine, parts):
            yield part, kind, pack_sorted(mine[at]), *(pack(c[at]) for c in n)


def _merged(key: tuple, group: pa.Table) -> pa.Table:
    """Sums of the counts of a range; of bigrams those seen by both halves."""
    pair = key[1].as_py()
    keys = np.concatenate([unpack_sorted(x.as_py()) for x in group.column("keys")])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(begins(keys))
    keys = keys[starts]
    sums = [np.add.reduceat(np.concatenate([unpack(x.as_py()) for x in group.column(c)])[order], starts) for c in COUNTS]
    if pair:
        both = (sums[1] > 0) & (sums[3] > 0)
        keys, sums = keys[both], [x[both] for x in sums]
    real = (keys != BEGIN) & (not pair)
    row = (key[0].as_py(), pair, pack_sorted(keys), *map(pack, sums), int(real.sum()), *(int(x[real].sum()) for x in sums))
    return pa.Table.from_batches([_rows([row], _TABLE)])


def _filter(docs: DataFrame, target: DataFrame) -> Column:
    """False only for documents that are none of ``target``: a bit for the hash of each of those."""
    kind = docs.schema["doc_id"].dataType
    if kind != target.schema["doc_id"].dataType:
        return F.lit(True)
    bits = min(FILTER_BITS, 1 << max(15, (16 * target.count()).bit_length()))
    place = 1 + F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bucket, bit = F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place)
    maps = target.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("bits"))
    seen = np.zeros((max(1, bits >> 15), 4096), np.uint8)
    for r in maps.toLocalIterator():
        seen[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(seen.reshape(-1))

    @F.pandas_udf("boolean")
    def maybe(place: pd.Series) -> pd.Series:
        at = place.to_numpy() - 1
        return pd.Series(shared.value[at >> 3] >> (at & 7) & 1 == 1)

    return maybe(place)


def _counted(docs: DataFrame, target: DataFrame, parts: int) -> DataFrame:
    """Counts of all words and of the bigrams seen by both halves, a row for each range of their hashes; BEGIN counts texts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    marks = target.select("doc_id").distinct().withColumn("wanted", F.lit(1))
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(half(), F.lit(0)).alias("half"))
    rows = rows.withColumn("maybe", _filter(docs, target))
    # texts move to their mark only where there may be one
    marked = rows.filter("not maybe").select("text", (F.col("half") * 2).alias("kind")).unionByName(
        rows.filter("maybe").join(marks, "doc_id", "left").select("text", (F.col("half") * 2 + F.coalesce("wanted", F.lit(0))).alias("kind"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for part in slices(batch):
                words, pairs, first, owner = _tokens(part.column("text"))
                kinds = part.column("kind").to_numpy().astype(np.int8)[owner]
                none = np.zeros(len(words), np.uint64)
                held += [(words, pairs, kinds), (words, none, kinds), (np.full(first.sum(), BEGIN), none[first], kinds[first])]
                n += 2 * len(words)
                if n >= HELD:
                    yield from sent(held)
                    n = 0
        if held:
            yield from sent(held)

    def sent(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        made = list(_packed_counts(_tallied(held), parts))
        if made:
            yield _rows(made, _BLOCKS)

    return marked.mapInArrow(work, _BLOCKS).groupBy("part", "pair").applyInArrow(_merged, _TABLE)


@dataclass
class Models:
    """Counts by range of the hashes, words and bigrams apart."""

    table: DataFrame
    parts: int  # ranges
    scale: np.ndarray  # of counts, by half and model
    total: np.ndarray  # scaled words, by half and model
    begin: int  # distinct words and an unknown one


def fit(docs: DataFrame, target: DataFrame) -> Models:
    """Counts all of ``docs`` for the background and those whose doc_id is in ``target`` for the target."""
    spark = docs.sparkSession
    parts = _pieces(docs, RANGE)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        table = Scratch(spark).stored(_counted(docs, target, parts))
    finally:
        spark.conf.set(_CLEANUP, before)
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n0", "n1", "n2", "n3")]).first()
    sizes = np.array(sums[1:], float).reshape(2, 2)
    scale = np.stack((np.ones(2), sizes[:, 0] / np.maximum(1.0, sizes[:, 1])), axis=1)
    return Models(table, parts, scale, sizes * scale, sums[0] + 1)


def _read(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, bigrams, where a text begins and the row of each word, of all texts; read in slices, so that little else is held."""
    read, rows = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64))], 0
    for batch in group.to_batches():
        for part in slices(batch):
            words, pairs, first, owner = _tokens(part.column("text"))
            read.append((words, pairs, first, owner + rows))
            rows += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*read))


def _asked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, BEGIN among them, and distinct bigrams of the texts, in order."""
    words, pairs, _, _ = _read(group)
    return distinct(np.append(words, BEGIN)), distinct(pairs)


def _answered(asked: pa.Table, held: pa.Table) -> Iterator[tuple]:
    """(chunk, part, pair, found, target, background) for each chunk that asks: counts of the other half, of the keys found."""
    if not held.num_rows or not asked.num_rows:
        return  # words that the models lack give no loss, nor do their bigrams
    keys, *counts = (unpack_sorted(held.column("keys")[0].as_py()), *(unpack(held.column(c)[0].as_py()) for c in COUNTS))
    for chunk, part, pair, wanted in zip(*(asked.column(c).to_pylist() for c in ("chunk", "part", "pair", "keys"))):
        wanted = unpack_sorted(wanted)
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        other = 2 * (1 - chunk % 2)
        yield chunk, part, pair, pack(np.packbits(found)), *(pack(counts[other + m][at[found]]) for m in range(2))


def _losses(models: tuple, chunk: int, group: pa.Table, answers: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words and both losses of each document."""
    parts, scale, total, begin = models
    other = 1 - chunk % 2
    words, pairs, first, owner = _read(group)
    keys, found_at = zip(numbered(np.append(words, BEGIN)), numbered(pairs))
    del words, pairs
    (x, start), both = np.split(found_at[0], [-1]), found_at[1]
    v = np.where(first, start, np.roll(x, 1))
    places = [dict(_ranges(k, parts)) for k in keys]
    known = np.zeros(len(keys[0]), bool)
    counts = [[np.zeros(len(k)) for _ in range(2)] for k in keys]
    for part, pair, found, *given in zip(*(answers.column(c).to_pylist() for c in ("part", "pair", "found", "target", "background"))):
        at = places[pair][part]
        hits = at.start + np.flatnonzero(np.unpackbits(unpack(found).astype(np.uint8), count=at.stop - at.start))
        for m in range(2):
            counts[pair][m][hits] = unpack(given[m])
        if not pair:
            known[hits] = True
    losses = []
    for m in range(2):
        unigram = UNIGRAM_WEIGHT * (counts[0][m] * scale[other, m] + UNIFORM_WEIGHT / begin) / (total[other, m] + UNIFORM_WEIGHT)
        use = np.where(known, -np.log(unigram), 0.0)
        before = np.where(known, np.log(counts[0][m] * scale[other, m] + UNIGRAM_WEIGHT), 0.0)
        loss = use[x] + before[v]
        times = counts[1][m][both]
        seen = np.flatnonzero(times)
        loss[seen] -= np.log1p(times[seen] * scale[other, m] / unigram[x[seen]])
        losses.append(np.bincount(owner, loss, group.num_rows))
    return np.bincount(owner, minlength=group.num_rows), losses


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Per document doc_id, n_words, target_loss, background_loss and score, their difference.

    Texts that are null or without words have 0 words and 0 losses.  Texts are read whole; repeated rows get equal
    results; an empty table gives none; without target documents every score is that of an unseen target.  A null doc_id
    counts to the first half.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    chunks = _pieces(docs, 2 * CHUNK)
    # chunks hold one half; rows that share doc_id and text are spread by where they stand in the input
    place = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(half(), F.lit(0)).alias("half"))
    # both steps read this exchange of the texts
    rows = rows.select("doc_id", "text", (place * 2 + F.col("half")).alias("chunk")).repartition("chunk")
    parts, numbers = models.parts, (models.parts, models.scale, models.total, models.begin)

    made = "n_words long, target_loss double, background_loss double, score double"
    out = StructType([*rows.select("doc_id").schema.fields, *_parse_datatype_string(made).fields])
    arrow = to_arrow_schema(out)

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        made = [
            (key[0].as_py(), part, pair, pack_sorted(keys[at]))
            for pair, keys in zip((False, True), _asked(group.select(["text"]))) for part, at in _ranges(keys, parts)
        ]
        return pa.Table.from_batches([_rows(made, _ASKING)])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(list(_answered(asked, held)), _ANSWERS)])

    def lose(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        n, losses = _losses(numbers, key[0].as_py(), group, answers)
        target, background = (x / np.maximum(n, 1) for x in losses)
        columns = [group.column("doc_id"), *map(pa.array, (n, target, background, target - background))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    asked = rows.groupBy("chunk").applyInArrow(ask, _ASKING)
    answers = asked.groupBy("part", "pair").cogroup(models.table.groupBy("part", "pair")).applyInArrow(answer, _ANSWERS)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lose, out)
