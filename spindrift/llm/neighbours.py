"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected to a few dimensions by Gaussian directions, which makes
the squared projected distance of two vectors their squared distance times a
chi-square variable.  The projections lie in kd-trees.  A search takes the leaves
of a tree in order of their projected distance, in rounds that grow, and verifies
their vectors by true distances, all queries of a leaf in one matrix product; a
query stops when the test says that no nearer vector is likely any more: a
neighbour within the distance of the worst one found would, with probability
``confidence``, have come by now.

Equal vectors are one point with its smallest ids, so a vector that very many
rows share fills no cell; equal queries are one search.  A bounded sample of the
projections gives the splits of a coarse kd-tree, whose cells, of bounded bytes,
are spread over tasks, each with a kd-tree of its own; cells are dealt to parts
where they hold more than a task should.  A query first searches the cell it lies
in, and with the distances found there visits the cells that the test can't rule
out.

Defined results: vectors that are null, zero, of another length than the
commonest one, or that hold null or non-finite components take no part; ids that
repeat are candidates of their own, but never for a query of the same id, and a
query id with several vectors asks with the smallest of these; null ids take no
part; ties go to the smaller id; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import skew_join, stage, tidy

NEIGHBOURS, DIMENSIONS, CONFIDENCE = 10, 8, 0.95
#: Bytes of a cell's vectors, the sample that places the cells, and the points of a kd-tree's leaf.
CELL_BYTES, SAMPLE_POINTS, LEAF_POINTS = 32 << 20, 10_000, 64
#: Queries that a cell answers at a time, and points that a search carries beyond those asked for, as products round.
QUERIES, SPARE = 512, 6
SEED = 11


def chi_square(dimensions: int, x: np.ndarray | float):
    """The distribution function for an even number of dimensions."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.zeros_like(half)
    for k in range(dimensions // 2):
        total = total + term
        term = term * half / (k + 1)
    return 1 - np.exp(-half) * total


def quantile(dimensions: int, p: float) -> float:
    lo, hi = 0.0, 1e4
    while hi - lo > 1e-9 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(dimensions, mid) < p else (lo, mid)
    return hi


class KdTree:
    """Points in leaves, with the box of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_POINTS):
        self.points, self.leaves = points, []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            p = points[own]
            axis = int(np.ptp(p, axis=0).argmax())
            if len(own) <= leaf or np.ptp(p[:, axis]) == 0:
                self.leaves.append(own)
            else:
                order, half = np.argpartition(p[:, axis], len(own) // 2), len(own) // 2
                todo += [own[order[:half]], own[order[half:]]]
        self.lo = np.array([points[x].min(axis=0) for x in self.leaves])
        self.hi = np.array([points[x].max(axis=0) for x in self.leaves])

    def away(self, places: np.ndarray) -> np.ndarray:
        """The least squared projected distance of every leaf from every place."""
        out = np.zeros((len(places), len(self.leaves)))
        for d in range(places.shape[1]):
            gap = np.maximum(np.maximum(self.lo[:, d] - places[:, d, None], places[:, d, None] - self.hi[:, d]), 0)
            out += gap * gap
        return out


def search(tree: KdTree, vectors: np.ndarray, queries: np.ndarray, places: np.ndarray, k: int, bound: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers (-1 for none) and exact distances of the ``k`` nearest points found for each query, and how many were verified.

    ``bound``: a distance that k points are known to be within, and ``stop`` the test's quantile."""
    n, keep = len(queries), k + SPARE
    away = tree.away(places)
    order = np.argsort(away, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    norm, own_norm = (queries * queries).sum(axis=1), (vectors * vectors).sum(axis=1)
    best, number = np.full((n, keep), np.inf), np.full((n, keep), -1, np.int64)
    limit, seen, begin, end = bound.astype(float) ** 2, 0, 0, 1
    while begin < order.shape[1]:
        due = (rank >= begin) & (rank < end)
        if not (due & (away <= stop * limit[:, None])).any():
            break
        for leaf in np.flatnonzero(due.any(axis=0)):
            rows = np.flatnonzero(due[:, leaf] & (away[:, leaf] <= stop * limit))
            if not len(rows):
                continue
            own = tree.leaves[leaf]
            seen += len(rows) * len(own)
            gap = np.maximum(norm[rows, None] + own_norm[own] - 2 * (queries[rows] @ vectors[own].T), 0)
            near = (gap <= limit[rows, None] * (1 + 1e-9) + 1e-12).any(axis=1)
            rows, gap = rows[near], gap[near]
            both = np.concatenate([best[rows], gap], axis=1)
            names = np.concatenate([number[rows], np.broadcast_to(own, gap.shape)], axis=1)
            first = np.argpartition(both, keep - 1, axis=1)[:, :keep]
            best[rows], number[rows] = np.take_along_axis(both, first, axis=1), np.take_along_axis(names, first, axis=1)
            if len(rows):
                limit[rows] = np.minimum(limit[rows], np.partition(best[rows], k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12)
        begin, end = end, 4 * end
    exact = np.sqrt(np.square(vectors[number] - queries[:, None]).sum(axis=2))
    exact[number < 0] = np.inf
    first = np.argsort(exact, axis=1, kind="stable")[:, :k]
    number, exact = np.take_along_axis(number, first, axis=1), np.take_along_axis(exact, first, axis=1)
    return np.where(np.isfinite(exact), number, -1), exact, seen


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id and the vector as doubles, of rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    out = rows.select("vec_id", v.alias("vector")).where(ok)
    lengths = out.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "n").first()
    same = out.where(F.size("vector") == (lengths["n"] if lengths else 0)).withColumn("vector", F.transform("vector", lambda x: x + 0.0))
    return same.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))))))


def points(found: DataFrame, k: int) -> DataFrame:
    """(key, vector, ids): each different vector with its k+1 smallest ids, which is all that any query can need of it."""
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("key", "_salt").orderBy("vec_id"))).where(F.col("_nth") <= k + 1)
    return some.groupBy("key").agg(F.first("vector").alias("vector"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))


def _project(vectors: np.ndarray, dimensions: int) -> np.ndarray:
    return vectors @ np.random.default_rng(SEED).normal(size=(vectors.shape[1], dimensions))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Cells:
    """A coarse kd-tree over the projections: which cell a place lies in, and how far each cell is."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[tuple] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        d = sample.shape[1]
        self._cut(sample, cells, np.full(d, -np.inf), np.full(d, np.inf))
        self.lo, self.hi = (np.array([b[k] for b in self.boxes]) for k in (0, 1))

    def _cut(self, own, cells, lo, hi) -> int:
        at = len(self.splits)
        self.splits.append(None)
        axis = int(own.var(axis=0).argmax()) if len(own) else 0
        mid = float(np.median(own[:, axis])) if len(own) else 0.0
        if cells <= 1 or len(own) < 2 or not (own[:, axis] < mid).any():
            self.splits[at] = (-1, 0.0, len(self.boxes), -1)
            self.boxes.append((lo, hi))
            return at
        below = own[:, axis] < mid
        upper, lower = hi.copy(), lo.copy()
        upper[axis] = lower[axis] = mid
        left, right = self._cut(own[below], cells // 2, lo, upper), self._cut(own[~below], cells - cells // 2, lower, hi)
        self.splits[at] = (axis, mid, left, right)
        return at

    def of(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), np.int64)
        todo = [(0, np.arange(len(places)))]
        while todo:
            node, own = todo.pop()
            axis, mid, left, right = self.splits[node]
            if axis < 0:
                out[own] = left
            else:
                below = places[own, axis] < mid
                todo += [(left, own[below]), (right, own[~below])]
        return out

    def away(self, place: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.lo - place, place - self.hi), 0)
        return (gap * gap).sum(axis=1)


_FOUND = "asked binary, key binary, ids array<long>, score double"


def _searching(k: int, dimensions: int, stop: float):
    """In order of cell and part come points (kind 0) and then queries (kind 1); gives the nearest points of each query."""

    def answers(cell, queries):
        if cell is None or not queries:
            return
        tree, vectors, keys, ids = cell
        asked, q, bound = (np.concatenate(x) for x in zip(*queries, strict=True))
        number, exact, _ = search(tree, vectors, q, _project(q, dimensions), k, bound, stop)
        row, at = np.nonzero(number >= 0)
        if len(row):
            which = pa.array(number[row, at])
            yield pa.RecordBatch.from_arrays([pa.array(asked[row].tolist(), pa.binary()), keys.take(which), ids.take(which), pa.array(exact[row, at])], names=["asked", "key", "ids", "score"])

    def run(batches):
        held, cell, queries, name, waiting = [], None, [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "kind")], axis=1)
            edges = np.r_[0, np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1, len(mark)]
            for a, b in zip(edges, edges[1:], strict=False):
                if name != (mark[a, 0], mark[a, 1]):
                    yield from answers(cell, queries)
                    held, cell, queries, name, waiting = [], None, [], (mark[a, 0], mark[a, 1]), 0
                own = batch.slice(a, b - a)
                if mark[a, 2] == 0:
                    held.append(own.select(["key", "vector", "ids"]))
                    continue
                if cell is None and held:
                    vectors = np.concatenate([_matrix(x.column("vector")) for x in held])
                    keys, ids = (pa.chunked_array([x.column(c) for x in held]).combine_chunks() for c in ("key", "ids"))
                    cell, held = (KdTree(_project(vectors, dimensions)), vectors, keys, ids), []
                for lo in range(0, own.num_rows, QUERIES):
                    part = own.slice(lo, QUERIES)
                    queries.append((np.array(part.column("key").to_pylist(), object), _matrix(part.column("vector")), part.column("bound").to_numpy()))
                    waiting += part.num_rows
                    if waiting >= QUERIES:
                        yield from answers(cell, queries)
                        queries, waiting = [], 0
        yield from answers(cell, queries)

    return run


def nearest(rows: DataFrame, is_query, vector: str = "embedding", k: int = NEIGHBOURS, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found, for the rows that the column ``is_query`` (of vec_id) picks."""
    spark = rows.sparkSession
    found = stage(usable(rows, vector), "vectors")
    held = stage(points(found, k), "points")
    total = held.count()
    sample = held.orderBy("key").limit(SAMPLE_POINTS).select("vector").toArrow()["vector"].to_pylist()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(1, CELL_BYTES // (8 * len(sample[0])))
    cells = Cells(_project(np.array(sample), dimensions), max(1, -(-total // size)))
    shared = spark.sparkContext.broadcast(cells)
    stop = quantile(dimensions, confidence)

    def placed(batches):
        for batch in batches:
            at = shared.value.of(_project(_matrix(batch.column("vector")), dimensions)) if batch.num_rows else np.empty(0, np.int64)
            yield batch.append_column("cell", pa.array(at, pa.int64()))

    index = stage(held.mapInArrow(placed, "key binary, vector array<double>, ids array<long>, cell long"), "placed")
    # A cell that the sample made too large is dealt to parts, all of which its queries search.
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).cast("int").alias("parts"))  # a row for each cell
    index = index.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    queries = stage(found.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("vector", "key")).alias("v")).select("query_id", F.col("v.key").alias("key"), F.col("v.vector").alias("vector")), "queries")
    asked = queries.groupBy("key").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("times"))
    asked = stage(asked, "asked")

    def visit(batches):
        """The cells that each query has to search: its own at first; then those that the test doesn't rule out."""
        for batch in batches:
            out, bounds = [], batch.column("bound").to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            places = _project(_matrix(batch.column("vector")), dimensions)
            own = shared.value.of(places)
            for r, bound in enumerate(bounds):
                if np.isnan(bound):
                    out.append((own[r], r, math.inf))
                else:
                    out += [(int(c), r, bound) for c in np.flatnonzero(shared.value.away(places[r]) <= stop * bound * bound) if c != own[r]]
            if out:
                c, r, b = zip(*out, strict=True)
                at = pa.array(r, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), batch.column("key").take(at), batch.column("vector").take(at), pa.array(b, pa.float64())], names=["cell", "key", "vector", "bound"])

    def ran(questions: DataFrame) -> DataFrame:
        visits = questions.select("key", "vector", "bound").mapInArrow(visit, "cell long, key binary, vector array<double>, bound double")
        visits = visits.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        columns = ["cell", "part", "kind", "key", "vector", "ids", "bound"]
        both = index.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)}).select(*columns)
        both = both.unionByName(visits.withColumns({"kind": F.lit(1), "ids": F.lit(None).cast("array<long>")}).select(*columns))
        return both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(tidy(_searching(k + 1, dimensions, stop)), _FOUND)

    # A point more than asked for, as a query's own may be among them.
    order = Window.partitionBy("asked").orderBy("score", "key")
    best = lambda df: df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1).drop("_nth")
    first = stage(best(ran(asked.withColumn("bound", F.lit(math.nan)))), "own-cell")
    answered = first
    if len(cells.boxes) > 1:
        kth = first.groupBy("asked").agg(F.when(F.count(F.lit(1)) > k, F.max("score")).otherwise(math.inf).alias("bound"))
        again = asked.join(kth, F.col("key") == F.col("asked"), "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
        answered = best(first.unionByName(ran(again)))
    lists = answered.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("near")).withColumnRenamed("asked", "key")
    met = skew_join(queries.select("query_id", "key"), lists.join(asked.select("key", "times"), "key"), "key", F.col("times"), queries.count())
    # Ties of the last points' ids are settled by id, as each point has its smallest ones.
    every = F.flatten(F.transform("near", lambda p: F.transform(p["ids"], lambda i: F.struct(p["score"].alias("score"), i.alias("vec_id")))))
    some = F.slice(F.array_sort(F.filter(every, lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    return met.select("query_id", F.posexplode(some).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
