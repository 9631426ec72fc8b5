"""Whitening of embeddings by their principal components, with mixed-precision refinement.

The covariance is summed where the vectors are: entries become whole numbers, so that sums and products are exact in
whatever order tasks finish. Its eigenvectors are computed in float32 and then corrected in a
higher precision by the iteration of Ogita and Aishima, which takes matrix products only and doubles the
number of right digits each time. That correction divides by the differences of eigenvalues; where these are too
close for the present precision, the eigenvectors of the cluster are first separated by a sub-solve,
the eigenproblem of the matrix shifted to the cluster and restricted to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes the whole number floor(SCALE c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: The higher precision: 64 bits of mantissa on x86, 113 on ARM; double where numpy has nothing longer.
HIGH = np.longdouble
#: Corrections at most; from float32 four are usual, and each sub-solve takes another.
ROUNDS = 30
#: Whole numbers that double products and sums hold exactly, and that a long holds.
_EXACT, _LONG = 1 << 53, 9.2e18


class Whitening(NamedTuple):
    """What the fit list of ``n`` vectors gives: ``sums`` per dimension, the ``trace`` of their covariance, and for each
    component (row) its unit vector in ``vectors`` and eigenvalue in ``values``, falling."""

    n: int
    sums: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        """The rows of ``whole``, centred, projected and scaled; NaN along components without variance."""
        spread = np.where(self.values > 0, np.sqrt(self.values), np.nan)
        return (self.n * whole - self.sums) / self.n @ (self.vectors / spread[:, None]).T


def whiten(
    table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` per vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those of another length than most
    (of equally frequent lengths, the smaller one). All others are the fit list: ``n`` vectors of whole numbers
    x = floor(1024 c) + 100000 with sums S. ``deviation`` is the sum over dimensions of (n x - S)^2. Components are numbered from 1 by
    falling eigenvalue of the covariance (divisor n); there are as many as dimensions at most. The
    entry of largest size of a component is positive. ``explained`` is the component's share of the variance. ``identity_error`` is
    the largest absolute entry of the measured covariance of ``whitened`` minus the identity.

    Every row gets rows of its own, also with a null or repeated ``vec_id``. Along a component without variance (fewer
    different vectors than components) ``whitened`` is null, and ``identity_error`` is over the others, null without any;
    ``explained`` is null if nothing varies. An empty table gives no rows. Equal eigenvalues get some orthonormal
    vectors of their common space. Other columns are not read. A deviation beyond a long is an error.
    """
    kind = table.schema[vec_id].dataType.simpleString()
    vectors = sound_vectors(table, vec_id, embedding)
    model = fit(vectors, components)
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.select("vec_id", *(F.lit(None).alias(c) for c in ("component", "n", "deviation", "whitened"))).select(
            "*", F.lit(None).alias("explained"), F.lit(None).alias("identity_error")
        ).where("false").to(vectors.sparkSession.createDataFrame([], schema).schema)
    error = identity_error(vectors, model)
    width = len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(width, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = whole_numbers(batch.column("vector"))
            rows = len(whole)
            repeated = np.repeat(np.arange(rows), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(repeated)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * width, model.n)),
                    pa.array(deviations(whole, model)[repeated]),
                    pa.array(model.whitened(whole).ravel(), from_pandas=True),
                    pa.array(np.tile(explained, rows), from_pandas=True),
                    pa.array(np.full(rows * width, np.nan if error is None else error), from_pandas=True),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)


def sound_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part."""
    given = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = given.where("vector IS NOT NULL AND size(vector) > 0").where(
        "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    lengths = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("vector") == (lengths["n"] if lengths else 0))


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows of whole numbers."""
    flat = np.floor(vectors.flatten().to_numpy() * float(SCALE))
    if len(flat) and np.abs(flat).max() > _LONG / 4:
        raise ValueError("an entry is too large for whole numbers of 64 bits")
    return flat.reshape(len(vectors), -1).astype(np.int64) + OFFSET


def deviations(whole: np.ndarray, model: Whitening) -> np.ndarray:
    """The squared distance of each row from the mean, n^2 times, exactly."""
    apart = model.n * whole - model.sums
    if (np.square(apart.astype(np.float64)).sum(axis=1) > _LONG).any() or (np.abs(whole).max(initial=0) > _LONG / max(model.n, 1)):
        raise ValueError("a deviation does not fit into 64 bits")
    return np.square(apart).sum(axis=1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``vectors`` (``vector``), or None without any. The driver gets sums and covariance only."""
    count = vectors.count()
    if not count:
        return None
    sums = np.array(_summed(vectors, lambda whole: whole.sum(axis=0, keepdims=True))[0], object)
    middle = np.array([round_half(int(s), count) for s in sums], np.int64)

    def products(whole: np.ndarray) -> np.ndarray:
        return exact_products(whole - middle)

    squares = np.array(_summed(vectors, products), object)
    rest = sums - count * middle.astype(object)  # what centring by whole numbers leaves, less than half of n
    covariance = count * squares - np.outer(rest, rest)  # n^2 times the covariance, exact
    values, found = eigen(_high(covariance, count * count))
    size = min(components, len(values))
    values, found = values[::-1][:size], found[:, ::-1][:, :size]
    biggest = np.abs(found).argmax(axis=0)
    found = found * np.sign(found[biggest, np.arange(size)])
    trace = float(sum(int(covariance[d, d]) for d in range(len(covariance))) / count**2)
    noise = len(sums) * float(np.finfo(HIGH).eps) * trace
    values = np.where(values > noise, values, 0).astype(np.float64)
    return Whitening(count, np.array(sums.tolist(), np.int64), trace, found.T.astype(np.float64), values)


def round_half(total: int, count: int) -> int:
    """total / count to the nearest whole number."""
    return (2 * total + count) // (2 * count)


def exact_products(centred: np.ndarray) -> np.ndarray:
    """The sum of the outer products of rows of whole numbers: by double products as far as these are exact."""
    largest = int(np.abs(centred).max(initial=0))
    rows = _EXACT // max(1, largest * largest)
    if not rows:
        return centred.T @ centred
    total = np.zeros((centred.shape[1],) * 2, np.int64)
    for at in range(0, len(centred), rows):
        part = centred[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _summed(vectors: DataFrame, measure: Callable[[np.ndarray], np.ndarray]) -> list[list[int]]:
    """The sum over all batches of a matrix of whole numbers; each of its rows is added up by one task of few partials."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = measure(whole_numbers(batch.column("vector")))
                total = found if total is None else total + found
        if total is not None:
            rows = pa.array(list(total), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), rows], ["row", "entries"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, entries in zip(batch.column("row").to_pylist(), batch.column("entries"), strict=True):
                values = entries.values.to_numpy()
                totals[row] = totals[row] + values if row in totals else values
        rows = pa.array(list(totals.values()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), rows], ["row", "entries"])

    schema = "row int, entries array<bigint>"
    found = vectors.select("vector").mapInArrow(partial, schema).repartition("row").mapInArrow(added, schema)
    return [r["entries"] for r in sorted(found.collect(), key=lambda r: r["row"])]  # as many rows as dimensions


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity.

    Every task centres its vectors at their own mean; means and covariances of tasks are then merged.
    """
    used = model.values > 0
    width = int(used.sum())
    if not width:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _moments(((len(rows), rows.mean(axis=0), _centred(rows)) for rows in whitened_rows(batches)), width)

    def whitened_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                yield model.whitened(whole_numbers(batch.column("vector")))[:, used]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                for n, mean, spread in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "spread")), strict=True):
                    yield n, np.array(mean), np.array(spread).reshape(width, width)

        yield from _moments(rows(), width)

    schema = "n long, mean array<double>, spread array<double>"
    found = vectors.select("vector").mapInArrow(partial, schema).repartition(1).mapInArrow(merged, schema).first()
    covariance = np.array(found["spread"]).reshape(width, width) / found["n"]
    return float(np.abs(covariance - np.eye(width)).max())


def _centred(rows: np.ndarray) -> np.ndarray:
    apart = rows - rows.mean(axis=0)
    return apart.T @ apart


def _moments(found: Iterator[tuple[int, np.ndarray, np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    """Counts, means and sums of centred products as one."""
    count, mean, spread = 0, np.zeros(width), np.zeros((width, width))
    for n, other, products in found:
        apart = other - mean
        spread += products + np.outer(apart, apart) * (count * n / (count + n))
        mean += apart * (n / (count + n))
        count += n
    if count:
        columns = [pa.array([count], pa.int64()), *(pa.array([x.ravel()], pa.list_(pa.float64())) for x in (mean, spread))]
        yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "spread"])


def _high(whole: np.ndarray, divisor: int) -> np.ndarray:
    """A matrix of whole numbers divided, in the higher precision."""
    parts = [[divmod(int(x), divisor) for x in row] for row in whole]
    return np.array([[HIGH(q) + HIGH(r) / HIGH(divisor) for q, r in row] for row in parts], HIGH)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of a symmetric matrix, rising, and its eigenvectors as columns, in the higher precision."""
    scale = np.abs(matrix).max(initial=0)
    if not scale > 0:
        return np.zeros(len(matrix), HIGH), np.eye(len(matrix), dtype=HIGH)
    scaled = matrix / scale
    _, start = np.linalg.eigh(scaled.astype(np.float32))
    values, vectors = refined(scaled, start.astype(HIGH))
    order = np.argsort(values, kind="stable")
    return values[order] * scale, vectors[:, order]


def refined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``matrix``, from eigenvectors of a lower precision."""
    size, step = len(matrix), np.inf
    exact = 4 * size * float(np.finfo(HIGH).eps)
    for _ in range(ROUNDS):
        values, change, bound = correction(matrix, vectors)
        vectors = vectors + vectors @ change
        open_clusters = [c for c in clusters(values, bound) if separable(matrix, vectors, values, c, exact)]
        for cluster in open_clusters:
            vectors[:, cluster] = separated(matrix, vectors[:, cluster], values[cluster])
        before, step = step, float(np.abs(change).max())
        if not open_clusters and (step <= exact or (step >= before / 2 and step < 1e-12)):
            break
    for _ in range(2):  # corrections across very small gaps leave vectors a little oblique
        vectors = vectors + vectors @ ((np.eye(size, dtype=HIGH) - vectors.T @ vectors) / 2)
    return correction(matrix, vectors)[0], vectors


def correction(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, the correction E (vectors + vectors E are better ones), and the distance from which eigenvalues are told apart."""
    lack = np.eye(len(matrix), dtype=HIGH) - vectors.T @ vectors
    seen = vectors.T @ matrix @ vectors
    values = np.diag(seen) / (1 - np.diag(lack))
    off = seen - np.diag(values)
    bound = 2 * (_norm(off) + _norm(matrix) * _norm(lack))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > bound
    return values, np.where(apart, (seen + values[None, :] * lack) / np.where(apart, gaps, 1), lack / 2), bound


def _norm(matrix: np.ndarray) -> float:
    return float(np.linalg.norm(matrix.astype(np.float64), 2))


def clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """The places of eigenvalues that stand in chains of steps up to ``bound``, where there are two or more."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [c for c in np.split(order, ends) if len(c) > 1]


def _restricted(matrix: np.ndarray, vectors: np.ndarray, middle: float) -> np.ndarray:
    shifted = vectors.T @ (matrix @ vectors - middle * vectors)
    return (shifted + shifted.T) / 2


def separable(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray, cluster: np.ndarray, exact: float) -> bool:
    """Whether the shifted matrix mixes a cluster's vectors by more than rounding; else its eigenvalues are equal or its vectors right."""
    shifted = _restricted(matrix, vectors[:, cluster], values[cluster].mean())
    mixed = np.abs(shifted - np.diag(np.diag(shifted))).max()
    return bool(mixed > exact * np.abs(matrix).max())


def separated(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors of the same space that are eigenvectors of the matrix shifted to the cluster and restricted to it.

    The shift takes off what the eigenvalues share, so that double precision is enough for what they differ by.
    """
    _, turned = np.linalg.eigh(_restricted(matrix, vectors, values.mean()).astype(np.float64))
    turned = turned.astype(HIGH)
    turned = turned + turned @ ((np.eye(len(turned), dtype=HIGH) - turned.T @ turned) / 2)
    return vectors @ turned
