"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample of the vectors: a node's hyperplane stands across the
line between two of its vectors, at their median. Every vector is then put into one leaf of each
tree. A query searches all trees through one priority queue, nearest hyperplanes first, and is
sent to the leaves it finds; there the vectors are compared with it exactly.

The measure is the inner product. Vectors get a further coordinate that brings all to one length,
so that the largest inner product is the smallest distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import thinned
from .shingles import mixed

#: Vectors that the trees are grown on at most, and those of a leaf there at least.
SAMPLE, LEAF = 16_384, 32
TREES, DEPTH = 32, 8
#: Leaves that a query visits. On vectors with no structure, recall needs about half of them all.
VISITS = 288
#: Vectors of a leaf that one task compares; larger leaves are cut into blocks.
BLOCK = 4096


class Forest(NamedTuple):
    """``normals`` (tree, node, coordinate) and ``cuts`` (tree, node) of complete trees; node k has children 2k + 1 and 2k + 2."""

    depth: int
    longest: float
    normals: np.ndarray
    cuts: np.ndarray


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part, each once.

    Rows with a null id or vector, with null or non-finite components, or that are zero take none, nor do
    rows of another length than most (of equally frequent lengths, the smaller one).
    """
    given = table.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = given.where("id IS NOT NULL AND vector IS NOT NULL").where(
        "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)"
    )
    lengths = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("vector") == (lengths["n"] if lengths else 0))


def grow(vectors: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest | None:
    """The forest of ``vectors`` (``id``, ``vector``), or None if there are none. Reruns agree."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    longest, count = vectors.agg(F.max(square), F.count("*")).first()
    if longest is None:
        return None
    longest = float(np.sqrt(longest))
    few = thinned(vectors, 2 * SAMPLE / count, "id", "vector")
    sample = few.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).toPandas()
    points = with_length(np.array(sample["vector"].tolist(), np.float64), longest)
    depth = max(0, min(depth, int(np.log2(max(1, len(points) / LEAF)))))
    random = np.random.default_rng(seed)
    normals = np.zeros((trees, 2**depth - 1, points.shape[1]))
    cuts = np.zeros((trees, 2**depth - 1))
    for tree in range(trees):
        owner = np.zeros(len(points), np.int64)
        for node in range(2**depth - 1):
            own = np.flatnonzero(owner == node)
            normal = np.zeros(points.shape[1])
            if len(own) >= 2:
                one, other = points[random.choice(own, 2, replace=False)]
                normal = one - other
            if not normal.any():
                normal = random.normal(size=points.shape[1])
            normals[tree, node] = normal / np.linalg.norm(normal)
            along = points[own] @ normals[tree, node]
            cuts[tree, node] = np.median(along) if len(own) else 0.0
            owner[own] = 2 * node + 1 + (along > cuts[tree, node])
    return Forest(depth, longest, normals, cuts)


def with_length(rows: np.ndarray, longest: float) -> np.ndarray:
    """A further coordinate brings rows up to length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (rows**2).sum(axis=1)))
    return np.column_stack((rows, rest))


def leaves(points: np.ndarray, forest: Forest) -> np.ndarray:
    """The leaf of each point (row) in each tree (column)."""
    trees = len(forest.cuts)
    node = np.zeros((len(points), trees), np.int64)
    for _ in range(forest.depth):
        for tree in range(trees):
            own = node[:, tree]
            along = np.einsum("ij,ij->i", points, forest.normals[tree, own])
            node[:, tree] = 2 * own + 1 + (along > forest.cuts[tree, own])
    return node - (2**forest.depth - 1)


def search_order(query: np.ndarray, forest: Forest, sizes: np.ndarray, visits: int, least: int) -> Iterator[tuple[int, int]]:
    """The (tree, leaf) places of a query, by a priority queue that all trees share.

    A place's priority is the smallest margin on the way to it. Empty leaves are passed over. The search ends after
    ``visits`` leaves, but not before one tree's leaves hold ``least`` vectors, or all leaves have been visited.
    """
    inner = 2**forest.depth - 1
    margins = forest.normals @ query - forest.cuts
    queue = [(-np.inf, tree, 0) for tree in range(len(forest.cuts))]
    visited, held = 0, np.zeros(len(forest.cuts), np.int64)
    while queue and (visited < visits or held.max() < least):
        priority, tree, node = heapq.heappop(queue)
        if node >= inner:
            if sizes[tree, node - inner]:
                visited += 1
                held[tree] += sizes[tree, node - inner]
                yield tree, node - inner
            continue
        margin = margins[tree, node]
        heapq.heappush(queue, (max(priority, margin), tree, 2 * node + 1))
        heapq.heappush(queue, (max(priority, -margin), tree, 2 * node + 2))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, visits: int = VISITS, **options) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` nearest found of each query, nearest first.

    ``vectors`` and ``queries`` are as ``valid_vectors`` returns them. Candidates are all vectors of another id than the
    query's, each once if rows repeat; ties go to the smaller id. Scores are inner products of the original vectors, added up
    in double precision from the first coordinate to the last. A query with fewer candidates gets all of them.

    Of equal vectors only those with the k + 1 smallest ids can be among the k nearest, so the others
    are left out, whatever their number.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    forest = grow(vectors, **options)
    if forest is None:
        return spark.createDataFrame([], schema)
    copies = Window.partitionBy("vector").orderBy("id")
    single = vectors.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1)
    single = single.select("id", "vector").dropDuplicates()
    shared = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE and the number of trees
    sizes = np.zeros((len(forest.cuts), 2**forest.depth), np.int64)
    for row in _leaf_sizes(single, shared).collect():  # a row for each leaf of the forest
        sizes[row["tree"], row["leaf"]] = row["n"]
    layout = spark.sparkContext.broadcast(sizes)
    dealt = _placed(single, shared, layout)
    asked = _asked(queries.dropDuplicates(), shared, layout, visits, k + 1)
    both = dealt.union(asked).repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "asks")
    found = both.mapInArrow(_compared(k), "query_id long, query_hash long, vec_id long, score double")
    best = found.groupBy("query_id", "query_hash", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _leaf_sizes(vectors: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        counts = np.zeros((len(forest.cuts), 2**forest.depth), np.int64)
        for batch in _parts(batches):
            for tree, found in enumerate(leaves(with_length(_matrix(batch), forest.longest), forest).T):
                counts[tree] += np.bincount(found, minlength=counts.shape[1])
        tree, leaf = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tree, leaf, counts[tree, leaf])], ["tree", "leaf", "n"])

    counted = vectors.select("vector").mapInArrow(run, "tree long, leaf long, n long")
    return counted.groupBy("tree", "leaf").agg(F.sum("n").alias("n"))


_PLACED = "id long, vector array<double>, tree long, leaf long, block long, asks boolean"


def _rows(ids: np.ndarray, rows: pa.Array, tree: np.ndarray, leaf: np.ndarray, block: np.ndarray, asks: bool) -> pa.RecordBatch:
    columns = [pa.array(ids), rows, *(pa.array(c, pa.int64()) for c in (tree, leaf, block)), pa.array(np.full(len(ids), asks))]
    return pa.RecordBatch.from_arrays(columns, ["id", "vector", "tree", "leaf", "block", "asks"])


def _placed(vectors: DataFrame, shared: Broadcast, layout: Broadcast) -> DataFrame:
    """Each vector once for each tree, with its leaf there and its block of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, blocks = shared.value, -(-layout.value // BLOCK)
        for batch in _parts(batches):
            found = leaves(with_length(_matrix(batch), forest.longest), forest)
            ids = batch.column("id").to_numpy()
            dealt = mixed(ids.astype(np.uint64)) >> np.uint64(1)
            for tree in range(found.shape[1]):
                block = dealt.astype(np.int64) % blocks[tree, found[:, tree]]
                yield _rows(ids, batch.column("vector"), np.full(len(ids), tree), found[:, tree], block, False)

    return vectors.select("id", "vector").mapInArrow(run, _PLACED)


def _asked(queries: DataFrame, shared: Broadcast, layout: Broadcast, visits: int, least: int) -> DataFrame:
    """Each query once for each block of each leaf that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes = shared.value, layout.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for k, row in enumerate(_matrix(batch)):
                scaled = np.append(row * (forest.longest / np.linalg.norm(row)), 0.0)
                places = [
                    (tree, leaf, block)
                    for tree, leaf in search_order(scaled, forest, sizes, visits, least)
                    for block in range(-(-sizes[tree, leaf] // BLOCK))
                ]
                tree, leaf, block = np.array(places, np.int64).reshape(-1, 3).T
                repeated = batch.column("vector").take(pa.array(np.full(len(tree), k)))
                yield _rows(np.full(len(tree), ids[k]), repeated, tree, leaf, block, True)

    return queries.select("id", "vector").mapInArrow(run, _PLACED)


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Added up coordinate by coordinate, so a score depends on the two vectors alone."""
    total = np.zeros(rows.shape[:-1])
    for j in range(rows.shape[-1]):
        total += rows[..., j] * query[..., j]
    return total


def _compared(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        rest: list[pa.RecordBatch] = []
        place = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(n).to_numpy().astype(np.int64) for n in ("tree", "leaf", "block")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if place is not None and place != tuple(keys[start]):
                    best.compare(pa.Table.from_batches(rest))
                    rest = []
                place = tuple(keys[start])
                rest.append(batch.slice(start, end - start))
        if rest:
            best.compare(pa.Table.from_batches(rest))
        yield from best.rows()

    return run


class _Best:
    """The k best candidates so far of every query that a task has seen."""

    def __init__(self, k: int, pending: int = 400_000):
        self.k, self.pending, self.parts, self.size = k, pending, [], 0

    def compare(self, table: pa.Table) -> None:
        """A block of a leaf: its vectors first, then the queries that visit it."""
        asks = table.column("asks").to_numpy()
        n = int((~asks).sum())
        if not n or n == len(asks):
            return
        matrix = np.concatenate([_matrix(b) for b in table.select(["vector"]).to_batches()])
        ids = table.column("id").to_numpy()
        rows, row_ids = matrix[:n], ids[:n]
        for at in range(n, len(asks), 256):
            queries, query_ids = matrix[at : at + 256], ids[at : at + 256]
            rough = queries @ rows.T
            rough[query_ids[:, None] == row_ids[None, :]] = -np.inf
            if n > self.k:
                kth = -np.partition(-rough, self.k - 1, axis=1)[:, self.k - 1]
                chosen = rough >= kth[:, None] - 1e-9 * (1 + np.abs(kth[:, None]))
            else:
                chosen = np.ones_like(rough, bool)
            q, r = np.nonzero(chosen & np.isfinite(rough))
            hashes = np.array([hash_of(v) for v in queries], np.int64)
            self.add(query_ids[q], hashes[q], row_ids[r], inner_products(rows[r], queries[q]))

    def add(self, *columns: np.ndarray) -> None:
        if not len(columns[0]):
            return
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > self.pending:
            self.parts = [self.kept()]
            self.size = len(self.parts[0][0])
            self.pending = max(self.pending, 2 * self.size)

    def kept(self) -> tuple[np.ndarray, ...]:
        query, hashes, ids, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, hashes, query))
        query, hashes, ids, score = query[order], hashes[order], ids[order], score[order]
        same = np.concatenate(([False], (query[1:] == query[:-1]) & (hashes[1:] == hashes[:-1])))
        again = same & np.concatenate(([False], (ids[1:] == ids[:-1]) & (score[1:] == score[:-1])))
        query, hashes, ids, score, same = (c[~again] for c in (query, hashes, ids, score, same))
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        first = np.arange(len(same)) - starts < self.k
        return query[first], hashes[first], ids[first], score[first]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in self.kept()], ["query_id", "query_hash", "vec_id", "score"]
            )


def hash_of(vector: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest((vector + 0.0).tobytes()) - (1 << 63)
