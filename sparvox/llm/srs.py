"""Approximate nearest neighbours by low-dimensional stable projections (SRS) under a kd-tree.

Vectors of length one are projected onto M Gaussian directions. The squared distance of two projections, over the squared distance of the
vectors, is chi-square with M degrees of freedom: so neighbours are fetched in order of projected distance and verified in full, until the
next projected distance r is such that anything still unseen and nearer than the K-th found, at distance d, would have shown up
with probability CERTAIN: P(chi-square <= r^2 / d^2) >= CERTAIN.

The kd-tree is spread over tasks. Its upper levels are fitted on a bounded sample (SAMPLE vectors, those with the smallest hash of their ids) so
that cells have about CELL vectors, but at least FITTED of the sample, which bounds what every task knows of them; every vector is put in its
cell, and a cell that has more than CELL (say, of copies, or of a very large table) in several blocks by hash. A task builds the lower levels of a block's tree and streams queries over it. A query first visits its own cell; what it finds there
gives d, and only the cells that come within r of its projection are visited then. Each block returns at most K.

Nearness is the cosine of the original vectors in double precision; for unit vectors that is the same order as distance. Vectors are first
scaled by a power of two to a largest component between 1/2 and 1: that changes no digit, and no square over- or underflows.

Defined results: vectors that are null, zero, hold nulls or non-finite components, or have another length than most have (ties: the longer) take no part, nor do
rows with a null id; ties go to the smaller id; repeated rows are candidates each, but never for a query of their own id; a query that
occurs twice is answered twice; with fewer than K candidates all are returned; an empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvox.llm import _chi2
from sparvox.runtime import cut, stage, workers_see_package

M = 16
K = 5
CERTAIN = 0.95
SAMPLE = 20_000
FITTED = 8
CELL = 5_000
LEAF = 128


def directions(size: int, m: int) -> np.ndarray:
    return np.random.default_rng(20250101).standard_normal((size, m))


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def project_batches(batches: Iterator[pa.RecordBatch], size: int, m: int) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, vector, point): rows that take part, with the vector in double precision and its projection."""
    from pyspark import TaskContext

    row, d = TaskContext.get().partitionId() << 33, directions(size, m)
    for batch in batches:
        keep = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and v is not None and len(v) == size and None not in v]
        v = np.array([v for _, v in keep], np.float64).reshape(-1, size)
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])
        n = norms(v)
        good = np.isfinite(v).all(axis=1) & np.isfinite(n) & (n > 0)
        ids, v = np.array([i for i, _ in keep], np.int64)[good], v[good]
        points = (v / n[good][:, None]) @ d
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + len(ids))), pa.array(ids), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in points], pa.binary())],
            ["row", "vec_id", "vector", "point"],
        )
        row += len(ids)


class Cells:
    """The upper levels of the kd-tree: axis and threshold of each inner node, and every cell's box."""

    def __init__(self, sample: np.ndarray, cells: int, m: int):
        levels = max(0, int(np.ceil(np.log2(max(1, cells)))))
        self.levels, self.axis, self.at = levels, np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        lo, hi = np.full((1 << levels, m), -np.inf), np.full((1 << levels, m), np.inf)
        groups, boxes = [sample], [(np.full(m, -np.inf), np.full(m, np.inf))]
        for level in range(levels):
            new_groups, new_boxes = [], []
            for k, (g, (a, b)) in enumerate(zip(groups, boxes)):
                axis = int(np.ptp(g, axis=0).argmax()) if len(g) else 0
                at = float(np.median(g[:, axis])) if len(g) else 0.0
                self.axis[(1 << level) + k], self.at[(1 << level) + k] = axis, at
                left, right = b.copy(), a.copy()
                left[axis], right[axis] = min(b[axis], at), max(a[axis], at)
                new_groups += [g[g[:, axis] < at], g[g[:, axis] >= at]]
                new_boxes += [(a, left), (right, b)]
            groups, boxes = new_groups, new_boxes
        for k, (a, b) in enumerate(boxes):
            lo[k], hi[k] = a, b
        self.lo, self.hi = lo, hi

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (1 << self.levels)

    def within(self, point: np.ndarray, square: float) -> np.ndarray:
        """Cells that come within the distance."""
        gap = np.maximum(0, np.maximum(self.lo - point, point - self.hi))
        return np.flatnonzero((gap * gap).sum(axis=1) <= square)


class Tree:
    """A kd-tree over one block: leaves of up to LEAF points with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        order, todo, leaves = np.arange(len(ids)), [np.arange(len(ids))], []
        while todo:
            part = todo.pop()
            spread = np.ptp(points[part], axis=0)
            if len(part) <= LEAF or not spread.max():
                leaves.append(part)
                continue
            axis = spread.argmax()
            half = np.argpartition(points[part, axis], len(part) // 2)
            todo += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.points, self.norms = ids[order], vectors[order], points[order], norms(vectors[order])
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.lo, self.hi = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, factor: float, bound: float) -> list[tuple[float, int]]:
        """Up to k (cosine, id), best first. bound: the squared distance of the k-th that is known from elsewhere."""
        gap = np.maximum(0, np.maximum(self.lo - point, point - self.hi))
        near = (gap * gap).sum(axis=1)
        length = float(norms(vector[None])[0])
        best: list[tuple[float, int]] = []
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > factor * bound:
                break
            some = slice(self.starts[leaf], self.ends[leaf])
            away = self.points[some] - point
            pick = np.flatnonzero(((away * away).sum(axis=1) <= factor * bound) & (self.ids[some] != own)) + self.starts[leaf]
            if not len(pick):
                continue
            cosines = (self.vectors[pick] * vector).sum(axis=1) / (self.norms[pick] * length)
            best = sorted([*best, *((-c, i) for c, i in zip(cosines.tolist(), self.ids[pick].tolist()))])[:k]
            if len(best) == k:
                bound = min(bound, max(0.0, 2 + 2 * best[-1][0]) * (1 + 1e-9) + 1e-12)
        return [(-c, i) for c, i in best]


def search_batches(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Rows come by (cell, block), a block's vectors (role 0) before its queries (role 1); gives each query's best of the block."""
    now, held, tree = None, [], None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        cells, blocks, roles = (np.asarray(batch.column(c)) for c in ("cell", "block", "role"))
        change = np.ones(len(batch), bool)
        change[1:] = (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (roles[1:] != roles[:-1])
        cuts = [*np.flatnonzero(change).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if now != (cells[lo], blocks[lo]):
                now, held, tree = (cells[lo], blocks[lo]), [], None
            ids = np.asarray(part.column("vec_id"))
            vectors, points = (np.frombuffer(b"".join(part.column(c).to_pylist())).reshape(len(part), -1) for c in ("vector", "point"))
            if roles[lo] == 0:
                held.append((ids, vectors, points))
                continue
            if tree is None and held:
                tree, held = Tree(*(np.concatenate(x) for x in zip(*held))), []
            if tree is None:
                continue
            bounds = np.asarray(part.column("bound"))
            for row, own, vector, point, bound in zip(part.column("row").to_pylist(), ids.tolist(), vectors, points, bounds.tolist()):
                for score, i in tree.search(own, vector, point, k, factor, bound):
                    for column, value in zip(out, (row, own, i, score)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["row", "query_id", "vec_id", "score"])


def nearest(df: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, m: int = M, certain: float = CERTAIN) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df to each of its rows for which queries holds."""
    spark = df.sparkSession
    workers_see_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked"))
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    size, factor = lengths["size"], _chi2.inverse(certain, m)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparvox.llm import srs

        return srs.project_batches(batches, size, m)

    points = stage(rows.select("vec_id", "vector").mapInArrow(project, "row long, vec_id long, vector binary, point binary"), "points")
    count = points.count()
    sample = [np.frombuffer(r["point"]) for r in points.select("vec_id", "point").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("point").collect()]
    cells = Cells(np.array(sample).reshape(-1, m), min(-(-count // CELL), SAMPLE // FITTED), m)

    def cell_of(values: pa.Array) -> pa.Array:
        return pa.array(cells.of(np.frombuffer(b"".join(values.to_pylist())).reshape(-1, m)), pa.int64())

    placed = stage(points.withColumn("cell", F.arrow_udf(cell_of, "long")("point")), "cells")
    blocks = cut(placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("blocks")))
    small = F.broadcast(blocks)  # a row for each cell: at most 2 * SAMPLE / FITTED of them
    data = placed.join(small, "cell").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).select("cell", "block", F.lit(0).alias("role"), "row", "vec_id", "vector", "point", F.lit(0.0).alias("bound"))
    asked = rows.where(F.col("asked") & F.col("vec_id").isNotNull()).select("vec_id").distinct()
    asking = placed.join(asked, "vec_id", "left_semi").select("cell", "row", "vec_id", "vector", "point")

    def search(visits: DataFrame) -> DataFrame:
        """visits: cell, row, vec_id, vector, point, bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from sparvox.llm import srs

            return srs.search_batches(batches, k, factor)

        each = visits.join(small, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        each = each.select("cell", "block", F.lit(1).alias("role"), "row", "vec_id", "vector", "point", "bound")
        ordered = data.unionByName(each).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
        return cut(ordered.mapInArrow(run, "row long, query_id long, vec_id long, score double"))

    home = search(asking.withColumn("bound", F.lit(float("inf"))))
    bounds = home.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("worst"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    bounds = bounds.select("row", F.when(F.size("scores") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.get("scores", F.lit(k - 1))) * (1 + 1e-9) + 1e-12).alias("known"))

    def others(own: pa.Array, point: pa.Array, bound: pa.Array) -> pa.Array:
        found = []
        for c, p, b in zip(own.to_pylist(), point.to_pylist(), bound.to_pylist()):
            near = cells.within(np.frombuffer(p), factor * b)
            found.append(near[near != c])
        return pa.array(found, pa.list_(pa.int64()))

    further = asking.join(bounds, "row", "left").withColumn("bound", F.coalesce("known", F.lit(float("inf"))))
    further = further.withColumn("cell", F.explode(F.arrow_udf(others, "array<long>")("cell", "point", "bound"))).drop("known")
    found = home.unionByName(search(further))
    ranked = found.groupBy("row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    flat = ranked.select("query_id", F.posexplode("best").alias("at", "b"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
