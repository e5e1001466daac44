"""Centroid clustering of whole-number vectors by filtering in kd-trees.

Vectors become whole numbers, floor(scale * x) a component, so that every sum,
distance and tie is exact and the result does not depend on how the input is split.

1. A task builds a kd-tree for every TREE_ROWS vectors that it reads, and writes it:
   the vectors in the tree's order, and of every node its range, its box and the sum
   of its vectors.  Trees are written once, in the shared folder, and serve all rounds.
2. A round sends the centroids down each tree, level by level.  At a node the
   candidate nearest to the middle of the box is kept; any other that is strictly
   farther at the corner of the box that favours it most is farther from every
   vector in it and is dropped.  A node with one candidate left is assigned whole, by
   its count and sum; the vectors of leaves with several are compared one by one.
3. A task gives one row, its sums; these are added in a tree of SLOTS groups, whose
   rows the driver adds: k x dims numbers each, whatever the input.

In 64 dimensions boxes are wide, so most of what is saved are nodes of equal or very
near vectors (a third of all rows may be one vector: its node has a box of one point).

The rounds run while the result's plan is made.

Edge cases: vectors of another size, or null, or with a component that is null or not
finite are left out; a null id is an id like any other, whose hash sorts last;
repeated rows count each; starting vectors with one id are taken in the order of
their components; ties go to the smaller centroid number, also between equal
centroids, of which the others stay empty and stay where they are; fewer vectors than
k give as many centroids; an empty table gives no rows; components beyond what doubles
multiply exactly are handled in Python's whole numbers, by comparison one by one, and
a distance or inertia beyond 64 bits is null; extra columns are ignored and may have
any name.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.scratch import Scratch

TREE_ROWS, LEAF_ROWS = 8192, 32
SLOTS = 256


def exact_bound(dims: int) -> int:
    """Components up to this give sums of products that doubles hold exactly."""
    return int((2**50 / dims) ** 0.5)


class Tree:
    """Vectors in tree order, and nodes in breadth-first order: range, left child (-1: leaf; the right one follows it), box, sum.

    A wide tree has large components: it holds the unscaled doubles alone, which are scaled to Python's whole numbers when read.
    """

    FIELDS = (("points", np.int32), ("start", np.int32), ("end", np.int32), ("left", np.int32), ("low", np.int32), ("high", np.int32), ("sum", np.int64))

    def __init__(self, wide: bool, dims: int, **parts):
        self.wide, self.dims = wide, dims
        self.__dict__ |= parts

    @classmethod
    def build(cls, x: np.ndarray, scale: int) -> tuple[Tree, np.ndarray]:
        """The tree of rows of doubles, scaled, and the order of its rows."""
        n, dims = x.shape
        order = np.arange(n)
        if np.abs(x).max() > exact_bound(dims) / scale:
            return cls(True, dims, points=x), order
        x = np.floor(scale * x)
        start, end, left, at = [0], [n], [], 0
        while at < len(start):
            a, b = start[at], end[at]
            own = x[order[a:b]]
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(spread.argmax())
            if b - a <= LEAF_ROWS or spread[axis] == 0:
                left.append(-1)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                left.append(len(start))
                start += [a, a + half]
                end += [a + half, b]
            at += 1
        x = x[order].astype(np.int32)
        nodes = [x[a:b] for a, b in zip(start, end, strict=True)]
        parts = {"points": x, "start": start, "end": end, "left": left, "low": [v.min(axis=0) for v in nodes], "high": [v.max(axis=0) for v in nodes], "sum": [v.sum(axis=0, dtype=np.int64) for v in nodes]}
        return cls(False, dims, **{k: np.asarray(parts[k], kind) for k, kind in cls.FIELDS}), order

    def dump(self) -> dict[str, bytes | None]:
        if self.wide:
            return {k: None for k, _ in self.FIELDS} | {"points": self.points.tobytes()}
        return {k: getattr(self, k).tobytes() for k, _ in self.FIELDS}

    @classmethod
    def load(cls, wide: bool, dims: int, scale: int, row: dict) -> Tree:
        if wide:
            return cls(True, dims, points=scaled(np.frombuffer(row["points"], np.float64), scale).reshape(-1, dims))
        flat = {"start", "end", "left"}
        return cls(False, dims, **{k: np.frombuffer(row[k], kind).reshape(-1 if k in flat else (-1, dims)) for k, kind in cls.FIELDS})


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's whole numbers, for doubles of any size."""
    return np.array([math.floor(Fraction(v) * scale) for v in x.tolist()], object)


def nearest(tree: Tree, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, centroid of each node, points, centroid of each point), which together cover the tree once.

    z: distinct centroids in the order of their numbers, Python's whole numbers.
    """
    none = np.zeros(0, np.int64)
    if tree.wide or max(abs(v) for v in z.flat) > exact_bound(tree.dims):
        x = tree.points.astype(object)
        near = (z * z).sum(axis=1)[None] - 2 * (x @ z.T)
        return none, none, np.arange(len(x)), np.array([min(range(len(z)), key=row.__getitem__) for row in near.tolist()], np.int64)
    z = z.astype(np.float64)
    square = (z * z).sum(axis=1)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    done, own, leaves = [none], [none], [none]
    while len(nodes):
        low, high = tree.low[nodes].astype(np.float64), tree.high[nodes].astype(np.float64)
        middle = np.where(alive, square[None] - (low + high) @ z.T, np.inf).argmin(axis=1)
        for c in np.unique(middle):
            rows = np.flatnonzero(middle == c)
            step = z - z[c]
            # how much farther than c each one is, at the corner that favours it most
            gap = (square - square[c])[None] - 2 * (high[rows] @ np.maximum(step, 0).T + low[rows] @ np.minimum(step, 0).T)
            alive[rows] &= gap <= 0
        one = alive.sum(axis=1) == 1
        done.append(nodes[one])
        own.append(middle[one])
        left = tree.left[nodes]
        leaves.append(nodes[~one & (left < 0)])
        deeper = ~one & (left >= 0)
        nodes, alive = np.concatenate([left[deeper], left[deeper] + 1]).astype(np.int64), np.concatenate([alive[deeper], alive[deeper]])
    leaf = np.concatenate(leaves)
    points = np.concatenate([none, *(np.arange(tree.start[i], tree.end[i]) for i in leaf)])
    best = (square[None] - 2 * (tree.points[points].astype(np.float64) @ z.T)).argmin(axis=1)
    return np.concatenate(done), np.concatenate(own), points, best


def distinct(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct centroids and their numbers; of equal ones the smallest number."""
    first: dict[tuple, int] = {}
    for k, c in enumerate(centroids):
        first.setdefault(tuple(c), k)
    return np.array(list(first), object).reshape(len(first), -1), np.array(list(first.values()))


def _trees(dims: int, scale: int):
    def emit(ids, held):
        tree, order = Tree.build(np.concatenate(held), scale)
        row = tree.dump()
        ids = pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([tree.wide]), *(pa.array([row[k]], pa.binary()) for k, _ in Tree.FIELDS)], ["ids", "wide", *(k for k, _ in Tree.FIELDS)])

    def run(batches):
        ids, held, n = [], [], 0
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            at = 0
            while at < len(values):
                most = min(len(values) - at, TREE_ROWS - n)
                ids.append(batch.column(0).slice(at, most))
                held.append(values[at : at + most])
                at, n = at + most, n + most
                if n == TREE_ROWS:
                    yield emit(ids, held)
                    ids, held, n = [], [], 0
        if n:
            yield emit(ids, held)

    return run


_TREE = "ids array<long>, wide boolean, " + ", ".join(f"{k} binary" for k, _ in Tree.FIELDS)


def _rows(batches: Iterator[pa.RecordBatch], dims: int, scale: int):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i] for k in batch.schema.names}
            yield Tree.load(row["wide"].as_py(), dims, scale, {k: row[k].as_buffer() if row[k].is_valid else None for k, _ in Tree.FIELDS}), row["ids"].values


def _sums(centroids: list[list[int]], dims: int, scale: int):
    """One row a task: (part, sums), count and sum of each centroid's vectors as JSON, for whole numbers of any size."""

    def run(batches):
        z, number = distinct(centroids)
        count, total = [0] * len(centroids), np.zeros((len(centroids), dims), object)
        for tree, _ in _rows(batches, dims, scale):
            nodes, own, points, best = nearest(tree, z)
            x = tree.points
            for k in range(len(z)):
                mine, single = nodes[own == k], points[best == k]
                if len(mine) or len(single):
                    count[number[k]] += int((tree.end[mine] - tree.start[mine]).sum() if len(mine) else 0) + len(single)
                    whole = tree.sum[mine].sum(axis=0, dtype=np.int64).astype(object) if len(mine) else 0
                    total[number[k]] += whole + (x[single].sum(axis=0) if tree.wide else x[single].sum(axis=0, dtype=np.int64).astype(object))
        if any(count):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([json.dumps([count, total.tolist()])])], ["part", "sums"])

    return run


def added(rows: list[str]) -> tuple[list[int], np.ndarray]:
    count = total = None
    for n, t in map(json.loads, rows):
        t = np.array(t, object)
        count, total = (n, t) if count is None else ([a + b for a, b in zip(count, n, strict=True)], total + t)
    return count, total


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, part = None, None
    for batch in batches:
        for part, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "sums")), strict=True):
            count, total = added([sums] if now is None else [now, sums])
            now = json.dumps([count, total.tolist()])
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([now])], ["part", "sums"])


def _assigned(centroids: list[list[int]], dims: int, scale: int):
    limit = 2**63 - 1

    def run(batches):
        z, number = distinct(centroids)
        for tree, ids in _rows(batches, dims, scale):
            nodes, own, points, best = nearest(tree, z)
            which = np.empty(len(tree.points), np.int64)
            which[points] = best
            for i, c in zip(nodes, own, strict=True):
                which[tree.start[i] : tree.end[i]] = c
            if tree.wide or max(abs(v) for v in z.flat) > exact_bound(dims):
                step = tree.points.astype(object) - z[which]
                far = pa.array([v if v <= limit else None for v in (step * step).sum(axis=1)], pa.int64())
            else:
                step = tree.points - z.astype(np.int64)[which]
                far = pa.array((step * step).sum(axis=1))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(number[which].astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector kept; see the module."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce((F.size("v") == dims) & finite, F.lit(False)))
    first = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = [scaled(np.array(r["v"], np.float64), scale).tolist() for r in first]
    result = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = scratch.write(rows.mapInArrow(_trees(dims, scale), _TREE), "trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids, dims, scale), "part int, sums string").groupBy("part").applyInArrow(_add, "part int, sums string").collect()
        count, total = added([r["sums"] for r in sums])
        centroids = [[int(s) // n for s in t] if n else c for c, n, t in zip(centroids, count, total, strict=True)]
    found = scratch.write(trees.mapInArrow(_assigned(centroids, dims, scale), result), "found")
    scratch.drop("trees")
    # a distance beyond 64 bits makes its sums null too
    far = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) if r["known"] else None for r in found.groupBy("cluster").agg(far.alias("s"), (F.count("distance") == F.count("*")).alias("known")).collect()}
    bounded = lambda x: x if x is not None and x < 2**63 else None
    whole = bounded(None if None in inertia.values() else sum(inertia.values()))
    table = [(c, bounded(inertia[c]), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    return found.join(F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
