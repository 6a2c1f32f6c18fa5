"""Exact Jaccard join of documents on word n-grams, with rare-first prefix filtering.

Shingles are put into one global order, rare ones first.  Two sets that are alike enough share a shingle of their
prefixes, so only prefixes are indexed and joined; length and positional filters drop most of what meets.  What is left is
compared by parity maps, one bit or two for each shingle, whose differing bits are a lower bound of the differing shingles;
so the whole sets are read for few pairs but true ones, pass the suffix filter and are verified once per pair.

Groups of copies never give all their pairs.  Equal sets are one node.  A first round compares every node of a bucket
(the nodes with a prefix shingle) with one hub, the node in which that shingle stands first, which in a group of near
copies is the least changed one.  Linked nodes are joined to components; a second round compares only those pairs of a
bucket that are still in different components, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.llm.arrow import slices
from quernlog.llm.components import components
from quernlog.llm.native import Scratch, text_of
from quernlog.llm.textarrays import code_points, lower_ascii, mix64, word_hashes
from quernlog.session import materialized

#: Shingle frequencies are counted in 2 ** FREQUENCY_BITS counters by hash, sent in pieces of 2 ** PIECE_BITS; the order
#: they give need not be exact.  A shingle much more frequent than the square root of the shingles per counter stands out.
FREQUENCY_BITS = 24
PIECE_BITS = 14
#: Steps of the order in which a frequency doubles; 8 of them fit 32 doublings into a byte.
STEPS = 8
#: Bits per wanted row of the filter that picks the texts to read again, and most bits; more nodes only make it pass more.
ROW_BITS, FILTER_BITS = 64, 27


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct hashes of the word n-grams in rising order; the whole sequence where words are fewer; else none."""
    words = word_hashes(lower_ascii(code_points(text)))
    n = len(words)
    if n == 0:
        return words
    span = min(size, n)
    total = np.zeros(n - span + 1, np.uint64)
    for k in range(span):
        total = mix64(total + words[k : n - span + 1 + k])
    return np.unique(total + np.uint64(span < size))


def _node(found: np.ndarray) -> int:
    """Name of a set: equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return docs.select("doc_id", F.xxhash64("text").alias("key"), text_of().alias("text"))


def parity_map(s: np.ndarray) -> bytes:
    """One bit for each of 64 or more buckets of the hash, as many as shingles or up to twice that: whether their number is odd."""
    m = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Lower bound of the size of the symmetric difference of two sets, from their parity maps."""
    x, y = (np.frombuffer(v, np.uint8) for v in ((a, b) if len(a) >= len(b) else (b, a)))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _named_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per document (doc_id, key, n, node, map), key its text's hash, and per task the shingle counts (piece, counts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "n", "node", "map", "piece", "counts"]
    shift = np.uint64(64 - FREQUENCY_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FREQUENCY_BITS, np.uint16)
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            for part in slices(batch):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                if not sets:
                    continue
                at, found = np.unique(np.concatenate(sets) >> shift, return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + found, 0xFFFF)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([parity_map(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    ],
                    names,
                )
        for i, piece in enumerate(counts.reshape(-1, 1 << PIECE_BITS)):
            if piece.any():
                packed = pa.compress(piece.tobytes(), "zstd", asbytes=True)
                empty = [pa.nulls(1, t) for t in (ids, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([i], pa.int32()), pa.array([packed])], names)

    return _texts(docs).mapInArrow(work, f"doc_id {kind}, key long, n long, node long, map binary, piece int, counts binary")


def _frequencies(named: DataFrame) -> np.ndarray:
    """For each counter, the steps of its sum over all tasks: of a fixed size whatever the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(pa.decompress(packed, 2 << PIECE_BITS, "zstd"), np.uint16)
                sums[piece] = sums[piece] + found if piece in sums else found.astype(np.int64)
        for piece, found in sums.items():
            level = np.minimum(STEPS * np.log2(1 + found), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level.tobytes()])], ["piece", "level"])

    pieces = named.filter("piece is not null").select("piece", "counts").repartition("piece")
    levels = np.zeros((1 << (FREQUENCY_BITS - PIECE_BITS), 1 << PIECE_BITS), np.uint8)
    for row in pieces.mapInArrow(work, "piece int, level binary").toLocalIterator():
        levels[row["piece"]] = np.frombuffer(row["level"], np.uint8)
    return levels.reshape(-1)


def _prefixes(docs: DataFrame, size: int, percent: int, rank: np.ndarray) -> DataFrame:
    """Index rows (shingle, node, n, pos) of the prefix of every set, rare shingles first."""
    shift = np.uint64(64 - FREQUENCY_BITS)
    levels = docs.sparkSession.sparkContext.broadcast(rank)  # 16 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = levels.value
        seen: set[int] = set()  # equal sets have equal rows: once in a task is enough
        for batch in batches:
            for part in slices(batch):
                found, nodes, sizes, places = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, size)
                    if not len(s) or (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    order = np.lexsort((s, rank[(s >> shift).astype(np.int64)]))[:length]
                    found.append(s[order].view(np.int64))
                    nodes.append(np.full(length, node))
                    sizes.append(np.full(length, len(s), np.int32))
                    places.append(np.arange(length, dtype=np.int32))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (found, nodes, sizes, places)], ["shingle", "node", "n", "pos"]
                    )

    return _texts(docs).mapInArrow(work, "shingle long, node long, n int, pos int")


def _may_link(n: Column, pos: Column, other_n: Column, other_pos: Column, percent: int) -> Column:
    """Length filter, and positional filter for a pair's first common shingle."""
    most = F.least(n - pos, other_n - other_pos)
    return (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent) & (most * (100 + percent) >= (n + other_n) * percent)


def _sets_of(docs: DataFrame, size: int, nodes: DataFrame, representatives: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, shingles) of the given nodes, from the texts of their representatives; twice where a row is there twice."""
    wanted = materialized(representatives.select("node", "doc_id").join(nodes, "node", "left_semi"))
    bits = min(1 << FILTER_BITS, 1 << max(16, (ROW_BITS * wanted.count()).bit_length()))

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits))

    # a filter of at most 16 MB, so that texts that aren't wanted go no further; the join below is exact
    rows = (
        wanted.select(place("doc_id").alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    )
    words = np.zeros(bits // 64, np.int64)
    for row in rows.toLocalIterator():
        words[row["w"]] = row["b"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((words[at // 64] >> (at % 64)) & 1 == 1))
            for part in slices(batch):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "node", "shingles"],
                )

    read = _texts(docs).withColumn("place", place("doc_id")).mapInArrow(work, f"doc_id {kind}, node long, shingles binary")
    return scratch.stored(read.join(wanted, ["doc_id", "node"], "left_semi").drop("doc_id"))


def _suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """Least size of the symmetric difference of two rising arrays, from where the middle of one falls in the other."""
    if depth == 0 or len(a) == 0 or len(b) == 0:
        return abs(len(a) - len(b))
    middle = len(b) // 2
    at = int(np.searchsorted(a, b[middle]))
    there = int(at < len(a) and a[at] == b[middle])
    return _suffix_bound(a[:at], b[:middle], depth - 1) + _suffix_bound(a[at + there :], b[middle + 1 :], depth - 1) + 1 - there


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least ``percent`` times the union."""
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if _suffix_bound(a, b, 2) > len(a) + len(b) - 2 * need:
        return False
    return int(np.isin(a, b, assume_unique=True, kind="sort").sum()) >= need


def _alike(pairs: DataFrame, representatives: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity maps leave it open that they link."""
    one = representatives.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("map").alias("ma"))
    two = representatives.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("map").alias("mb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            apart = [differing(x, y) for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= most))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("sa"), batch.column("sb"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased.  Documents link when 100 times the common shingles is at
    least ``percent`` times all shingles of the two; component_id is the smallest doc_id reachable by links.  Texts that
    are null or without words have no shingle and link with nothing, not even each other.  Texts are used whole.  Rows
    that share a doc_id are compared each by its text.  A row without doc_id links only with equal sets and takes their
    component_id, else null.  An empty table gives no rows; columns beside doc_id and text are left out.  Sets and shingles are told
    apart by 64-bit hashes.
    """
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """As :func:`groups`, with the hash of the row's text as ``key`` and a name of its group as ``class``, null without words."""
    docs = docs.select("doc_id", "text")
    table = Scratch(docs.sparkSession)
    named = table.stored(_named_sets(docs, size))
    scratch = Scratch(docs.sparkSession)
    rows = named.filter("piece is null").select("doc_id", "key", "n", "node")
    representatives = scratch.stored(
        named.filter("node is not null and doc_id is not null").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("map").alias("map"))
    )
    index = scratch.stored(_prefixes(docs, size, percent, _frequencies(named)))
    # most shingles stand in one prefix: they go first, and what follows is worked out on few rows
    shared = materialized(
        index.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("shingle")
    )
    rows_of_buckets = scratch.stored(index.join(shared, "shingle"))
    first = F.shiftleft(F.col("pos").cast("long"), 40).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 40) - 1)))
    hubs = materialized(
        rows_of_buckets.withColumn("first", first).groupBy("shingle").agg(
            F.min_by("node", "first").alias("hub"), F.min_by("n", "first").alias("hub_n"), F.min_by("pos", "first").alias("hub_pos")
        )
    )
    buckets = rows_of_buckets.join(hubs, "shingle").filter("node <> hub")
    star = _may_link(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), percent)
    pairs = materialized(buckets.filter(star).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = _link(docs, size, percent, pairs, representatives)
    labels = components(links)
    more = materialized(_open_pairs(buckets, labels, percent))
    if not more.isEmpty():
        links = links.union(_link(docs, size, percent, more, representatives))
        labels = components(links)
    scratch.clear()
    named_groups = rows.join(labels, "node", "left").select("doc_id", "key", "n", F.coalesce("label", "node").alias("class"))
    named_groups = materialized(named_groups)
    table.clear()
    smallest = materialized(
        named_groups.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("k")).filter("k > 1").drop("k")
    )
    return named_groups.join(smallest, "class", "left").select(
        "doc_id", "key", "class", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id")
    )


def _link(docs: DataFrame, size: int, percent: int, pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    pairs = materialized(_alike(pairs, representatives, percent))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    scratch = Scratch(docs.sparkSession)
    links = materialized(_verified(pairs, _sets_of(docs, size, nodes, representatives, scratch), percent))
    scratch.clear()
    return links


def _open_pairs(buckets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket, its hub aside, that may link and are in different components.

    Buckets are split by classes of the sets' sizes, so wide that sets which may link are in the same or in adjacent ones.
    """
    rows = buckets.join(labels, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    split = rows.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("shingle")
    rows = materialized(rows.join(split, "shingle"))
    width = 1.0001 * math.log(100 / percent)
    rows = rows.withColumn("class", F.floor(F.log("n") / width) if width else F.col("n").cast("long"))
    one = rows.select("shingle", "class", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    two = rows.select(
        "shingle", F.explode(F.array("class", F.col("class") - 1)).alias("class"),
        F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"),
    )
    return (
        one.join(two, ["shingle", "class"]).filter("la <> lb and (na < nb or (na = nb and a < b))")
        .filter(_may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: one whose doc_id is the group's.

    Of rows equal in doc_id and text one stays; a row that shares its doc_id with one of another group is judged by its
    own text, and of several texts of a group under its doc_id one stays.  Documents without words and rows without
    doc_id all stay.
    """
    found = _grouped(docs, size, percent).filter("doc_id = component_id")
    wordless = found.filter("class is null").select("doc_id", "key")
    chosen = found.filter("class is not null").groupBy("class", "doc_id").agg(F.min("key").alias("key")).select("doc_id", "key")
    kept = wordless.union(chosen).distinct().select(F.col("doc_id").alias("_kept"), F.col("key").alias("_key"))
    repeated = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    named = docs.filter("doc_id is not null").join(kept, (F.col("doc_id") == F.col("_kept")) & (F.xxhash64("text") == F.col("_key")), "left_semi")
    return named.withColumn("_row", F.row_number().over(repeated)).filter("_row = 1").drop("_row").unionByName(docs.filter("doc_id is null"))
