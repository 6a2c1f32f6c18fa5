"""Runs of repeated words: maximal stretches that a short period explains, found per octave of the period.

A document is exploded into overlapping tiles for every octave ``[b, 2b)`` of the period.  Tiles are solved on their
own: from every tile boundary (a multiple of ``b``) the Z-function of the words, forwards and backwards, tells how far
each period of the octave holds.  What is found are fragments cut at the tile's ends; they are shuffled by document and
period and stitched to whole runs.  A document of up to ``TILE`` words is one tile in every octave.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quernlog.llm.arrow import map_texts
from quernlog.llm.native import Scratch, indices, let, text_of, words
from quernlog.llm.textarrays import mix64

#: Words of a tile; octaves with longer periods have longer ones.
TILE = 1 << 13
#: A tile holds so many times its octave's least period, so that a run crossing tiles is told in each of them.
WIDTH = 32
#: A run has at least so many words, and so many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = "array<struct<start: long, length: long, period: long>>"


def tiles(n: int, octave: int, tile: int = TILE) -> list[tuple[int, int]]:
    """Starts and ends of the tiles of a document of n words in the octave of periods from ``octave`` on."""
    width = max(tile, WIDTH * octave)
    if n <= width:
        return [(0, n)]
    return [(s, min(s + width, n)) for s in range(0, n - width // 2, width // 2)]


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays, read in growing pieces."""
    size, at, step = min(len(a), len(b)), 0, 64
    while at < size:
        end = min(size, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, 2 * step
    return size


def boundary_z(words: np.ndarray, boundary: int, period: int) -> tuple[int, int]:
    """Z-values at a boundary, backwards and forwards: how many words before and from it on equal those a period later."""
    forwards = _agreement(words[boundary:], words[boundary + period :])
    backwards = _agreement(words[:boundary][::-1], words[: boundary + period][::-1])
    return backwards, forwards


def fragments(numbers: np.ndarray, sizes: Sequence[int], tile: int = TILE) -> list[list[tuple[int, int, int]]]:
    """Per document the (period, start, end) of the stretches found in its tiles; ``numbers`` are all documents' words as numbers.

    A stretch cut at a tile's end, but not the document's, is kept from two periods on, others if they are runs.
    Periods that are multiples of one found for the same stretch are left out where that is seen at once.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    first = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
    blocks = mix64(numbers.astype(np.uint64) + np.uint64(1))  # name of the ``octave`` words from each place on
    owner = np.full(len(numbers), -1, np.int64)  # the found stretch that a word lies in
    found: list[tuple[int, int, int]] = []  # period, start and end by place in ``numbers``
    octave = 1
    while (large := [d for d, n in enumerate(sizes) if n >= max(LEAST_LENGTH, LEAST_EXPONENT * octave)]):
        cut = [(d, s, e) for d in large for s, e in tiles(sizes[d], octave, tile)]
        length = np.array([e - s for _, s, e in cut], np.int64)
        start = np.array([first[d] + s for d, s, _ in cut], np.int64)
        which = np.repeat(np.arange(len(cut)), length)
        place = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
        # every place is one period of the octave behind exactly one boundary
        boundary = (place // octave - 1) * octave
        some = np.flatnonzero((boundary >= 0) & (place + 2 * octave <= length[which]))
        left, right = start[which[some]] + boundary[some], start[which[some]] + place[some]
        some = some[(blocks[left] == blocks[right]) & (blocks[left + octave] == blocks[right + octave])]
        left, period = start[which[some]] + boundary[some], place[some] - boundary[some]
        if len(found) and len(some):
            known = np.array(found, np.int64)
            of = owner[left]
            p, s, e = (known[of, k] for k in range(3))
            told = (of >= 0) & (period % p == 0) & (s <= left) & (left + period + octave <= e)
            some, left, period = some[~told], left[~told], period[~told]
        order = np.lexsort((left, period, which[some]))
        left, period, which_tile = left[order], period[order], which[some][order]
        at = 0
        while at < len(left):
            k, q, c = int(which_tile[at]), int(period[at]), int(left[at])
            d, s, e = cut[k]
            low, high = int(first[d]) + s, int(first[d]) + e
            back, ahead = boundary_z(numbers[low:high], c - low, q)
            begin, end = c - back, c + ahead + q
            whole = (begin > low or s == 0) and (end < high or e == sizes[d])
            if end - begin >= (max(LEAST_LENGTH, LEAST_EXPONENT * q) if whole else 2 * q):
                out[d].append((q, begin - int(first[d]), end - int(first[d])))
                owner[begin:end] = len(found)
                found.append((q, begin, end))
            at += 1
            while at < len(left) and which_tile[at] == k and period[at] == q and left[at] < c + ahead:
                at += 1
        joined = blocks[: max(0, len(blocks) - octave)] * np.uint64(3) + mix64(blocks[octave:] + np.uint64(octave))
        blocks = np.concatenate((mix64(joined), blocks[len(joined) :]))
        octave *= 2
    return out


def _numbered(texts: list[str]) -> tuple[np.ndarray, list[int], list[list[str]]]:
    words = [_WORD.findall(t) for t in texts]
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = [len(w) for w in words]
    return np.fromiter((numbers[x] for w in words for x in w), np.int64, sum(sizes)), sizes, words


def _fragments_of(docs: DataFrame, keep: list[str], tile: int) -> DataFrame:
    def start():
        def run(texts: list[str]) -> dict[str, list]:
            words, sizes, split = _numbered(texts)
            found = fragments(words, sizes, tile)
            return {
                "fragments": [[{"period": q, "begin": s, "end": e} for q, s, e in f] for f in found],
                "whole": [t if f else None for t, f in zip(texts, found)],
                "collapsed": [None if f else " ".join(w) for w, f in zip(split, found)],
            }

        return run

    return map_texts(docs, keep, "fragments array<struct<period: long, begin: long, end: long>>, whole string, collapsed string", start)


def stitched(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Whole runs (keys, start, length, period) from fragments (keys, period, begin, end) of any tiles.

    Fragments of one period belong together where their matching words, up to a period before their end, meet.  Of
    the periods of one stretch the smallest stays.
    """
    one = [*keys, "period"]
    rows = pieces.select(*one, "begin", "end").distinct()
    before = Window.partitionBy(*one).orderBy("begin", "end")
    reach = F.max(F.col("end") - F.col("period")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("begin") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_part", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*one, "_part").agg(F.min("begin").alias("start"), F.max("end").alias("stop"))
    runs = runs.filter((F.col("stop") - F.col("start")) >= F.greatest(F.lit(LEAST_LENGTH), LEAST_EXPONENT * F.col("period")))
    runs = runs.groupBy(*keys, "start", "stop").agg(F.min("period").alias("period"))
    return runs.select(*keys, "start", (F.col("stop") - F.col("start")).alias("length"), "period")


def repeated(row_id: str, text: Column) -> Column:
    """The text; where 10 divides the id's CRC-32, its words from a place on replaced by as many of a period's, joined by a blank.

    Both come from the id, a null one counting as an empty text.
    """
    h = F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary"))

    def made(s: Column) -> Column:
        n, g = F.size(s.w), F.floor(s.h / 10)
        return let(
            F.struct(s.w.alias("w"), F.pmod(g, n).cast("int").alias("a"), (1 + F.floor((n - F.pmod(g, n)) / (3 + F.pmod(g, F.lit(8))))).cast("int").alias("p")),
            lambda t: F.array_join(
                F.transform(indices(F.size(t.w)), lambda i: F.get(t.w, F.when(i < t.a, i).otherwise(t.a + F.pmod(i - t.a, t.p)))), " "
            ),
        )

    return F.when((h % 10 == 0) & (F.size(words(text)) > 0), let(F.struct(words(text).alias("w"), h.alias("h")), made)).otherwise(text)


def collapse(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), tile: int = TILE) -> DataFrame:
    """Columns ``keep``, ``runs`` (array of start, length, period, by start and period) and ``collapsed`` per row of ``docs``.

    Words are runs without ASCII white space, numbered from 0.  A run is a stretch of at least 6 words and 4 periods
    with its smallest period that no neighbouring word extends.  ``collapsed`` has the words joined by one blank,
    without those that any run holds after its first period.

    Texts are used whole.  A null, empty or blank text has no run and an empty ``collapsed``.  Equal rows are worked
    out each, with equal results; rows that share ``keep`` are told apart by their text's hash.  An empty table gives no
    rows; columns beside ``keep`` and text are left out, so their names don't matter.
    """
    keep = list(keep)
    rows = docs.select(F.struct(*keep).alias("_row"), text_of().alias("text"))
    rows = rows.withColumn("_a", F.xxhash64("_row", "text")).withColumn("_b", F.xxhash64("text", F.lit(1)))
    found = _fragments_of(rows, ["_row", "_a", "_b"], tile)
    plain = found.filter(F.size("fragments") == 0).select("_row", F.array().cast(_RUNS).alias("runs"), "collapsed")
    odd = Scratch(docs.sparkSession).stored(found.filter(F.size("fragments") > 0).select("_row", "_a", "_b", "fragments", "whole"))
    pieces = odd.select("_a", "_b", F.explode("fragments").alias("f")).select("_a", "_b", "f.*")
    runs = stitched(pieces, ["_a", "_b"]).groupBy("_a", "_b").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select("_a", "_b", F.transform("runs", lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period"))).alias("runs"))
    joined = odd.select("_row", "_a", "_b", F.col("whole").alias("text")).join(runs, ["_a", "_b"], "left")
    joined = joined.select("_row", "text", F.coalesce("runs", F.array()).alias("runs"))
    marked = joined.select("_row", "runs", F.struct("text", F.transform("runs", lambda r: r.start + r.period).alias("from"), F.transform("runs", lambda r: r.start + r.length).alias("to")).alias("cut"))
    schema = StructType([marked.schema["_row"], *_parse_datatype_string(f"runs {_RUNS}, collapsed string").fields])
    return plain.union(marked.mapInArrow(_without_repeats, schema)).select("_row.*", "runs", "collapsed")


def _without_repeats(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = []
        for cut in batch.column("cut").to_pylist():
            words = _WORD.findall(cut["text"])
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, np.asarray(cut["from"], np.int64), 1)
            np.add.at(edges, np.asarray(cut["to"], np.int64), -1)
            texts.append(" ".join(w for w, k in zip(words, np.cumsum(edges)) if not k))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("runs"), pa.array(texts, pa.string())], ["_row", "runs", "collapsed"])
