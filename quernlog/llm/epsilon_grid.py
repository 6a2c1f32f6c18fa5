"""Cosine links among vectors by epsilon grid order.

Unit vectors link when their distance is at most epsilon = sqrt(2 - 2 * cosine).  They are turned to leading principal
axes, sorted by the cells of a grid of width epsilon on the first of them, and cut into intervals of that order.  Pairs of
intervals are found by descending a tree of intervals from its root: where the boxes of two are further apart than
epsilon, none of their parts are looked at.  The vectors of a pair of intervals meet in one task, which goes on halving
both and skips what is provably distant; what is provably close is linked without comparing.

Equal vectors are one node.  A pair of intervals gives link counts per node and a spanning forest, never all its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, BinaryType, IntegerType

from quernlog.llm.components import components
from quernlog.llm.native import Scratch
from quernlog.session import materialized

#: Leading principal axes that boxes and first comparisons use, and those of them that the grid order uses.
AXES, GRID = 16, 8
#: The axes are learned on about so many vectors; any axes give the same links.
SAMPLE = 4096
#: An interval holds at most so many bytes of vectors; there are at least so many intervals of at least so many rows.
INTERVAL_BYTES, INTERVALS, INTERVAL_ROWS = 1 << 25, 12, 64
#: Vectors of a leaf of the recursion within a task, and bits of a step down the tree of intervals.
LEAF, FAN = 256, 3
#: Cosines nearer than this to the threshold are worked out anew with exact sums.
DOUBT = 1e-9


def _vectors(column: pa.Array, kind: type) -> list[bytes | None]:
    """Components as bytes; None for null, empty and zero vectors and those with null or non-finite components."""
    if not pa.types.is_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind(0)  # no negative zeros
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out: list[bytes | None] = []
    for k in range(len(column)):
        v = values[offsets[k] : offsets[k + 1]] if valid[k] else values[:0]
        out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
    return out


def _with_bytes(vectors: DataFrame, row_id: str, vector: str) -> tuple[DataFrame, type]:
    """(id, vector) with the vector as bytes of its components, and their type."""
    kind = np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    column = F.col(vector) if kind is np.float32 else F.col(vector).cast("array<double>")
    rows = vectors.select(F.struct(F.col(row_id).alias("id")).alias("row"), column.alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(_vectors(batch.column("v"), kind), pa.binary())], ["row", "vector"])

    out = rows.mapInArrow(work, StructType([rows.schema["row"], StructField("vector", BinaryType())]))
    return out.select("row.id", "vector"), kind


def _scaled(vector: bytes | memoryview, kind: type) -> np.ndarray:
    """Components as doubles, the largest of them between a half and 1; powers of two leave their digits as they are."""
    v = np.frombuffer(vector, kind).astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _unit(vector: bytes | memoryview, kind: type) -> np.ndarray:
    v = _scaled(vector, kind)
    return v / np.sqrt(v @ v)


def _axes(nodes: DataFrame, kind: type, count: int) -> dict[int, np.ndarray]:
    """Leading principal axes per dimension, from a sample of about ``SAMPLE`` vectors by hash."""
    share = min(1.0, SAMPLE / max(count, 1))
    some = nodes.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vector")
    by_size: dict[int, list[np.ndarray]] = {}
    for row in some.toLocalIterator():
        v = _unit(row["vector"], kind)
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, found in by_size.items():
        if len(found) > 1 and size > 1:
            sample = np.array(found)
            _, _, turned = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
            out[size] = np.ascontiguousarray(turned[:AXES])
    return out


def _in_grid_order(nodes: DataFrame, kind: type, axes: dict[int, np.ndarray], epsilon: float, parts: int, scratch: Scratch) -> DataFrame:
    """(part, place, node, size, vector, lead, rows): nodes dealt in grid order to parts, numbered within each."""

    def lead(unit: np.ndarray) -> np.ndarray:
        out = np.zeros(AXES)
        turned = axes[len(unit)] @ unit if len(unit) in axes else unit[:AXES]
        out[: len(turned)] = turned
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(v.as_buffer(), kind) for v in batch.column("vector")]
            leads = np.array([lead(u) for u in units]).reshape(len(units), AXES)
            cells = np.floor(leads[:, :GRID] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("node", "rows", "vector")), pa.array([len(u) for u in units], pa.int32()),
                    pa.array(list(leads), pa.list_(pa.float64())), *(pa.array(cells[:, k]) for k in range(GRID)),
                ],
                ["node", "rows", "vector", "size", "lead", *(f"c{k}" for k in range(GRID))],
            )

    cells = [f"c{k}" for k in range(GRID)]
    rows = nodes.mapInArrow(place, "node long, rows long, vector binary, size int, lead array<double>, " + ", ".join(f"{c} int" for c in cells))
    key = ["size", *cells, "node"]
    ordered = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("node", "rows", "vector", "size", "lead")
    numbered = StructType([*ordered.schema.fields, StructField("part", IntegerType()), StructField("place", IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int32))],
                [*batch.schema.names, "part", "place"],
            )
            at += n

    return scratch.stored(ordered.mapInArrow(number, numbered))


def _gap(a: str, b: str) -> Column:
    """Square of the distance between the boxes of two intervals."""
    zero = F.lit(0.0)
    total = zero
    for k in range(AXES):
        d = F.greatest(zero, F.col(f"{a}l{k}") - F.col(f"{b}h{k}"), F.col(f"{b}l{k}") - F.col(f"{a}h{k}"))
        total = total + d * d
    return total


def _boxed(rows: DataFrame, name: Column, bounds: list[tuple[Column, Column]]) -> DataFrame:
    sums = [c for k, (low, high) in enumerate(bounds) for c in (F.min(low).alias(f"l{k}"), F.max(high).alias(f"h{k}"))]
    return rows.groupBy(name.alias("interval")).agg(F.min("least").alias("least"), F.max("most").alias("most"), *sums)


def interval_pairs(intervals: DataFrame, last: int, epsilon: float) -> DataFrame:
    """(a, b) with a <= b of all intervals whose boxes are within ``epsilon``, from a descent of the tree above them.

    ``intervals`` has one row (interval, least, most, l0, h0, ...) per interval: its dimensions and its box; ``last`` is
    the largest number.  Each step joins the pairs left to their parts.
    """
    bounds = [(F.col(f"l{k}"), F.col(f"h{k}")) for k in range(AXES)]
    levels = [intervals]
    while last:
        last >>= FAN
        levels.append(_boxed(levels[-1], F.shiftright("interval", FAN).cast("long"), bounds))
    pairs = levels[-1].select(F.col("interval").alias("a"), F.col("interval").alias("b"))

    def side(level: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{name}{c}") for c in level.columns if c != "interval"]
        return level.select(F.shiftright("interval", FAN).cast("long").alias(name), F.col("interval").alias(f"{name}_"), *columns)

    for level in levels[-2::-1]:
        level = materialized(level)
        met = pairs.join(side(level, "a"), "a").join(side(level, "b"), "b")
        near = (F.col("a_") <= F.col("b_")) & (F.col("aleast") <= F.col("bmost")) & (F.col("bleast") <= F.col("amost"))
        pairs = materialized(met.filter(near & (_gap("a", "b") <= epsilon * epsilon + DOUBT)).select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    return pairs


class _Joined:
    """Links between two slices of one dimension in grid order (the same slice twice for links within).

    A slice holds its unit vectors, their leading coordinates, the rows of each, and the scaled vector at a place.
    """

    def __init__(self, one: list, two: list, same: bool, cosine: float):
        self.one, self.two, self.same, self.cosine = one, two, same, cosine
        self.epsilon = np.sqrt(max(0.0, 2 - 2 * cosine))
        n, m = len(one[0]), 0 if same else len(two[0])
        self.label = np.arange(n + m)
        self.shift = 0 if same else n
        self.counts = np.zeros(n + m, np.int64)
        self.boxes: dict[tuple[bool, int, int], tuple[np.ndarray, ...]] = {}

    def box(self, second: bool, start: int, end: int) -> tuple[np.ndarray, ...]:
        second = second and not self.same
        key = (second, start, end)
        if key not in self.boxes:
            unit, lead = (self.two if second else self.one)[:2]
            part = lead[start:end]
            centre = unit[start:end].mean(axis=0) if end - start <= LEAF else np.zeros(0)
            radius = np.sqrt(((unit[start:end] - centre) ** 2).sum(axis=1).max()) if len(centre) else np.inf
            self.boxes[key] = part.min(axis=0), part.max(axis=0), centre, radius
        return self.boxes[key]

    def join(self, a: int, b: int, c: int, d: int) -> None:
        low, high, one, r = self.box(False, a, b)
        low2, high2, two, r2 = self.box(True, c, d)
        gap = np.maximum(0.0, np.maximum(low - high2, low2 - high))
        if gap @ gap > self.epsilon**2 + DOUBT:
            return
        if b - a <= LEAF and d - c <= LEAF:
            between = np.sqrt(((one - two) ** 2).sum())
            if between - r - r2 > self.epsilon + DOUBT:
                return
            self.leaf(a, b, c, d, between + r + r2 < self.epsilon - DOUBT)
        elif self.same and (a, b) == (c, d):
            k = (a + b) // 2
            self.join(a, k, a, k)
            self.join(a, k, k, b)
            self.join(k, b, k, b)
        elif b - a >= d - c:
            k = (a + b) // 2
            self.join(a, k, c, d)
            self.join(k, b, c, d)
        else:
            k = (c + d) // 2
            self.join(a, b, c, k)
            self.join(a, b, k, d)

    def leaf(self, a: int, b: int, c: int, d: int, close: bool) -> None:
        within = self.same and (a, b) == (c, d)
        if close:
            linked = np.ones((b - a, d - c), bool)
        else:
            unit, lead = self.one[:2]
            unit2, lead2 = self.two[:2]
            x, y = lead[a:b], lead2[c:d]
            apart = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            maybe = apart <= self.epsilon**2 + DOUBT
            if within:
                maybe = np.triu(maybe, 1)
            rows, columns = np.nonzero(maybe)
            if not len(rows):
                return
            if 8 * len(rows) > maybe.size:
                cosines = (unit[a:b] @ unit2[c:d].T)[rows, columns]
            else:
                cosines = np.einsum("ij,ij->i", unit[a + rows], unit2[c + columns])
            for k in np.flatnonzero(np.abs(cosines - self.cosine) <= DOUBT):
                cosines[k] = exact_cosine(self.one[3](a + rows[k]), self.two[3](c + columns[k]))
            linked = np.zeros(maybe.shape, bool)
            linked[rows, columns] = cosines >= self.cosine
        if within:
            linked = np.triu(linked, 1)
        weight, weight2 = self.one[2][a:b], self.two[2][c:d]
        s = self.shift
        self.counts[a:b] += linked @ weight2
        self.counts[s + c : s + d] += weight @ linked
        rows, columns = np.nonzero(linked)
        one, two = self.label[a + rows], self.label[s + c + columns]
        apart = one != two
        if apart.any():
            self.unite(np.unique(np.stack((one[apart], two[apart])), axis=1))

    def unite(self, pairs: np.ndarray) -> None:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for x, y in pairs.T.tolist():
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        change = np.arange(len(self.label))
        for x in list(root):
            change[x] = find(x)
        self.label = change[self.label]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with sums that are rounded once."""
    from math import fsum, sqrt

    return fsum(a * b) / (sqrt(fsum(a * a)) * sqrt(fsum(b * b)))


def _joined(table: pa.Table, kind: type, cosine: float) -> pa.Table:
    """Link counts (a, null, count) and forest links (a, b, null) of the vectors of one pair of intervals."""
    sides = []
    for side in (0, 1):
        rows = table.filter(pa.compute.equal(table.column("side"), side)).sort_by([("size", "ascending"), ("part", "ascending"), ("place", "ascending")])
        nodes, sizes = rows.column("node").to_numpy(), rows.column("size").to_numpy()
        vectors = rows.column("vector").to_pylist()
        leads = np.array(rows.column("lead").to_pylist(), float).reshape(len(nodes), AXES)
        found = {}
        for size in np.unique(sizes):
            i, j = np.searchsorted(sizes, [size, size + 1])
            units = np.array([_unit(v, kind) for v in vectors[i:j]])
            found[int(size)] = [units, leads[i:j], rows.column("rows").to_numpy()[i:j], lambda k, i=i, v=vectors: _scaled(v[i + k], kind), nodes[i:j]]
        sides.append(found)
    same = not sides[1]
    a, b, counts = [], [], []
    for size, one in sides[0].items():
        two = one if same else sides[1].get(size)
        if two is None:
            continue
        job = _Joined(one[:4], two[:4], same, cosine)
        job.join(0, len(one[0]), 0, len(two[0]))
        nodes = one[4] if same else np.concatenate((one[4], two[4]))
        some = np.flatnonzero(job.counts)
        forest = np.flatnonzero(job.label != np.arange(len(nodes)))
        a += [nodes[some], nodes[forest]]
        b += [np.full(len(some), -1), nodes[job.label[forest]]]
        counts += [job.counts[some], np.zeros(len(forest), np.int64)]
    empty = [np.zeros(0, np.int64)]
    return pa.table([pa.array(np.concatenate(x or empty), pa.int64()) for x in (a, b, counts)], ["a", "b", "n"])


def linked(vectors: DataFrame, cosine: float = 0.95, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row id, n_links, component_id) per row of ``vectors``.

    Two rows link when the cosine of their vectors, in double precision, is at least ``cosine`` (above 0); n_links counts
    the other rows linked directly, component_id is the smallest id reachable by links, the own one included.  Null,
    empty and zero vectors and those with null or non-finite components link with nothing, vectors of different
    lengths not with each other.  Rows that share an id are compared each; a row without id takes the id of its
    component, null if that has none.  An empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    rows, kind = _with_bytes(vectors, row_id, vector)
    nodes = scratch.stored(
        rows.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    sizes = nodes.agg(F.count("*").alias("n"), F.sum(F.length("vector")).alias("bytes")).first()
    count, size = sizes["n"], sizes["bytes"] or 0
    if count == 0:
        return rows.select(F.col("id").alias(row_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    per = max(INTERVAL_ROWS, min(-(-count // INTERVALS), INTERVAL_BYTES * count // size))
    parts = -(-count // per)
    ordered = _in_grid_order(nodes.select("node", "rows", "vector"), kind, _axes(nodes, kind, count), epsilon, parts, scratch)
    # one row per part of the order
    filled = ordered.groupBy("part").agg(F.count("*").alias("k"))
    offsets = filled.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("offset"))
    placed = ordered.join(offsets, "part").withColumn("interval", F.floor((F.col("offset") + F.col("place")) / per).cast("long"))
    lead = [(F.col("lead")[k], F.col("lead")[k]) for k in range(AXES)]
    boxes = _boxed(placed.withColumns({"least": F.col("size"), "most": F.col("size")}), F.col("interval"), lead)
    pairs = interval_pairs(materialized(boxes), parts - 1, epsilon)
    sides = pairs.select("a", "b", F.col("a").alias("interval"), F.lit(0).alias("side")).union(
        pairs.filter("a < b").select("a", "b", F.col("b").alias("interval"), F.lit(1).alias("side"))
    )
    met = sides.join(placed, "interval").withColumn("pair", F.col("a") * parts + F.col("b")).select("pair", "side", "part", "place", "node", "rows", "size", "vector", "lead")
    made = scratch.stored(met.groupBy("pair").applyInArrow(lambda t: _joined(t, kind, cosine), "a long, b long, n long"))
    counts = made.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(made.filter("n = 0").select("a", "b"))
    known = nodes.select("node", F.md5("vector").alias("key"), "id", "rows").join(counts, "node", "left").join(labels, "node", "left")
    known = scratch.stored(known.select("key", "id", F.coalesce("label", "node").alias("label"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n")))
    smallest = known.groupBy("label").agg(F.min("id").alias("component"), F.sum("n").alias("all")).filter(F.col("all") > 0)
    result = known.join(smallest, "label").select("key", F.col("n").alias("n_links"), "component")
    out = rows.select("id", F.md5("vector").alias("key")).join(result, "key", "left")
    return out.select(
        F.col("id").alias(row_id), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
