"""Linking rows with similar signatures, in blocks of bounded size.

Rows that share a key meet in groups. A group is cut into blocks and every pair of its
blocks becomes a task of its own, so that neither a task nor its result grows with the
group: it compares at most two blocks on arrays and returns a spanning forest of the links
it finds, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.references import splittable

#: Rows of a block that is compared by signatures, and of one that is compared by sets.
SIGNATURE_BLOCK, SET_BLOCK = 1024, 512


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (``key`` and others) whose key occurs more than once, with its count ``members``."""
    counts = keyed.groupBy(F.col("key").alias("own")).agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(splittable(counts), F.col("key") == F.col("own")).drop("own")


def in_block_pairs(rows: DataFrame, place: Column, size: int) -> DataFrame:
    """Every row once for each pair of blocks of its group that has its block; ``block`` is its own, ``i`` <= ``j``.

    ``rows`` has ``key`` and ``members``; ``place`` is a hash of the row that deals it to one
    of ceil(members / size) blocks. Groups of one block get i = j = 0.
    """
    blocks = F.ceil(F.col("members") / size).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(place, F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        *[c for c in rows.columns if c != "members"],
        "block",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
    )


def per_block_pair(rows: DataFrame, link: Callable, schema: str) -> DataFrame:
    """Applies ``link`` to every block pair, given as a table whose rows all have the same key, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            yield from link(table, starts).to_batches()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a stream sorted by key, i, j, with the places where groups start and the end."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j")]
        ends = (named[0][-1], named[1][-1], named[2][-1])
        cut = batch.num_rows
        while cut and (named[0][cut - 1], named[1][cut - 1], named[2][cut - 1]) == ends:
            cut -= 1
        if cut or (last is not None and last != ends):
            done = pa.Table.from_batches([*rest, batch.slice(0, cut)], schema=batch.schema)
            if done.num_rows:
                yield done, _starts(done)
            rest = []
        rest.append(batch.slice(cut))
        last = ends
    if rest:
        done = pa.Table.from_batches(rest)
        yield done, _starts(done)


def _starts(table: pa.Table) -> np.ndarray:
    change = np.ones(table.num_rows + 1, dtype=bool)
    change[1:-1] = False
    for name in ("key", "i", "j"):
        values = table.column(name).to_numpy()
        change[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def signatures(table: pa.Table, bits: int) -> np.ndarray:
    """The ``signature`` column as a matrix of slots."""
    column = table.column("signature").combine_chunks()
    data = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(data.to_pylist())
    return np.frombuffer(raw, dtype=f"u{bits // 8}").reshape(table.num_rows, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of differing slots of every row of ``a`` against every row of ``b``."""
    if len(a) * len(b) * a.shape[1] <= 1 << 16:  # small ones in one step
        return (a[:, None, :] != b[None, :, :]).sum(axis=2, dtype=np.uint16)
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for k in range(a.shape[1]):
        out += a[:, k, None] != b[None, :, k]
    return out


def sides(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two blocks of a group: twice the same if it is one block paired with itself."""
    first = np.flatnonzero(blocks == blocks.min())
    second = np.flatnonzero(blocks != blocks.min())
    return first, second if len(second) else first


def close_links(table: pa.Table, starts: np.ndarray, threshold: int, bits: int = 16) -> pa.Table:
    """A spanning forest of the rows of each group whose signatures differ in at most ``threshold`` slots."""
    slots, blocks = signatures(table, bits), table.column("block").to_numpy()
    crossing = table.column("i").to_numpy() != table.column("j").to_numpy()
    sizes = np.diff(starts)
    pairs = starts[:-1][(sizes == 2) & ~crossing[starts[:-1]]]
    near = pairs[(slots[pairs] != slots[pairs + 1]).sum(axis=1) <= threshold]
    left, right = [near], [near + 1]
    for start, size in zip(starts[:-1], sizes, strict=True):
        if size < 2 or (size == 2 and not crossing[start]):
            continue
        first, second = sides(blocks[start : start + size])
        if crossing[start] and first is second:
            continue
        a, b = forest(distances(slots[start + first], slots[start + second]) <= threshold)
        left.append(start + first[a])
        right.append(start + second[b])
    return ends(table, np.concatenate(left), np.concatenate(right))


def ends(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
    nodes = table.column("node")
    return pa.table({"a": nodes.take(pa.array(left)), "b": nodes.take(pa.array(right))})


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of a truth matrix that connect all that its true cells connect."""
    rows, columns = [], []
    open_rows, open_columns = near.any(axis=1), near.any(axis=0)
    while open_rows.any():
        front = np.array([open_rows.argmax()])
        open_rows[front] = False
        while len(front):
            hit = near[front] & open_columns
            reached = np.flatnonzero(hit.any(axis=0))
            rows.append(front[hit[:, reached].argmax(axis=0)])
            columns.append(reached)
            open_columns[reached] = False
            back = near[:, reached] & open_rows[:, None]
            front = np.flatnonzero(back.any(axis=1))
            rows.append(front)
            columns.append(reached[back[front].argmax(axis=1)] if len(front) else front)
            open_rows[front] = False
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(rows or [none]), np.concatenate(columns or [none])


def similar_links(
    table: pa.Table, starts: np.ndarray, threshold: int, percent: int, bits: int = 16
) -> pa.Table:
    """A spanning forest of the rows of each group whose sets (``shingles``) have that Jaccard similarity.

    Pairs whose signatures differ in more than ``threshold`` slots are left out, and so are
    pairs already connected; the others are compared on their full sets, closest first.
    """
    slots, blocks = signatures(table, bits), table.column("block").to_numpy()
    crossing = table.column("i").to_numpy() != table.column("j").to_numpy()
    column = table.column("shingles").combine_chunks()
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    left, right = [], []
    for start, size in zip(starts[:-1], np.diff(starts), strict=True):
        first, second = sides(blocks[start : start + size])
        if size < 2 or (crossing[start] and first is second):
            continue
        first, second = start + first, start + second
        apart = distances(slots[first], slots[second])
        n, m = (offsets[first + 1] - offsets[first])[:, None], (offsets[second + 1] - offsets[second])[None, :]
        able = (apart <= threshold) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if first is second or np.array_equal(first, second):
            able = np.triu(able, 1)
        a, b = np.nonzero(able)
        order = np.argsort(apart[a, b], kind="stable")
        root = {}
        for x, y in zip(first[a[order]].tolist(), second[b[order]].tolist(), strict=True):
            u, v = _root(root, x), _root(root, y)
            if u == v:
                continue
            p, q = values[offsets[x] : offsets[x + 1]], values[offsets[y] : offsets[y + 1]]
            both = np.intersect1d(p, q, assume_unique=True).size
            if 100 * both >= percent * (len(p) + len(q) - both):
                root[u] = v
                left.append(x)
                right.append(y)
    return ends(table, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))


def _root(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x
