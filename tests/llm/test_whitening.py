"""Whitening: against numpy and exact fractions, refinement on clustered eigenvalues, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PythonException

from conftest import TESTDATA
from sievecraft.llm.queries import op11_whitening
from sievecraft.llm.whitening import HIGH, eigen, exact_products, round_half, whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def by_numpy(vectors, components=8):
    whole = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    centred = whole - sums / n
    covariance = centred.T @ centred / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    exact = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums, strict=True)) for row in whole]
    return centred @ found / np.sqrt(values), exact, values / np.trace(covariance)


def test_table_against_numpy(spark):
    found = op11_whitening(spark, str(TESTDATA / "sf0.01")).toPandas().sort_values(["vec_id", "component"])
    given = spark.read.parquet(str(TESTDATA / "sf0.01/embeddings.parquet")).toPandas().sort_values("vec_id")
    white, exact, explained = by_numpy(given.embedding.tolist())
    assert found.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.vec_id.tolist() == np.repeat(given.vec_id, 8).tolist() and set(found.n) == {len(given)}
    assert np.abs(found.whitened.to_numpy().reshape(-1, 8) - white).max() < 1e-10
    assert found.deviation.tolist() == np.repeat(exact, 8).tolist()
    assert np.allclose(found.explained.to_numpy()[:8], explained, rtol=1e-12)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-10


def symmetric(values):
    random = np.random.default_rng(4)
    basis = np.linalg.qr(random.normal(size=(len(values),) * 2))[0].astype(HIGH)
    for _ in range(4):
        basis = basis + basis @ ((np.eye(len(values)) - basis.T @ basis) / 2)
    matrix = (basis * np.array(values, HIGH)) @ basis.T
    return (matrix + matrix.T) / 2, basis


@pytest.mark.parametrize(
    ("values", "apart"),
    [
        (np.arange(1.0, 41), 1e-15),
        (np.concatenate([1 + 1e-9 * np.arange(8), np.arange(2.0, 30)]), 1e-15),
        (np.concatenate([np.full(6, 3.0), 100 + 1e-8 * np.arange(20), 100 + 5e-6 + 1e-11 * np.arange(4)]), None),
        (10.0 ** -np.arange(0, 15, 0.5), None),
        (np.full(20, 2.5), None),
        (np.concatenate([np.zeros(30), [1, 2, 3]]), None),
        (np.array([5.0]), 1e-15),
    ],
)
def test_eigenvectors_are_refined_beyond_double(values, apart):
    if np.finfo(HIGH).eps > 1e-18:
        pytest.skip("no precision beyond double here")
    matrix, basis = symmetric(values)
    found, vectors = eigen(matrix)
    scale = np.abs(values).max()
    assert np.abs(found - np.sort(values)).max() < 1e-17 * scale * len(values)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-17 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-17
    if apart is not None:
        right = np.abs((basis[:, np.argsort(values)] * vectors).sum(axis=0))
        assert np.abs(1 - right).max() < apart


def test_float32_alone_is_not_enough():
    matrix, basis = symmetric(np.concatenate([1 + 1e-9 * np.arange(8), np.arange(2.0, 30)]))
    _, coarse = np.linalg.eigh(matrix.astype(np.float32))
    assert np.abs(1 - np.abs((basis * coarse).sum(axis=0))).max() > 1e-3


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.5, -2.0, 0.1], [0.0, 0.0, 0.0], [3.0, 1.0, -1.0], [0.3, 0.2, 0.9], [1.5, -2.0, 0.1]]
    bad = [None, [], [1.0], [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 0.0, 0.0], [1.0, -inf, 0.0]]
    rows = [(k, v) for k, v in enumerate(good[:-1])] + [(None, good[-1])] + [(100 + k, v) for k, v in enumerate(bad)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, component string").repartition(4)
    found = whiten(table).toPandas()
    white, exact, _ = by_numpy(good, 3)
    assert len(found) == 15 and set(found.n) == {5}
    for k, vec_id in enumerate([0, 1, 2, 3, None]):
        own = found[found.vec_id.isna() if vec_id is None else found.vec_id == vec_id].sort_values("component")
        assert np.allclose(own.whitened, white[k], atol=1e-12) and own.deviation.tolist() == [exact[k]] * 3
    assert found.identity_error.max() < 1e-12


def test_no_vectors_and_no_variance(spark):
    empty = whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    equal = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], SCHEMA))
    assert empty.dtypes == equal.dtypes
    rows = equal.collect()
    assert len(rows) == 4 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(0, None, None, None)}
    line = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], SCHEMA)).orderBy("component", "vec_id").collect()
    assert [r.whitened for r in line] == pytest.approx([-1, 1, None, None]) and line[0].identity_error < 1e-12


def test_too_large_for_whole_numbers(spark):
    with pytest.raises(PythonException, match="64 bits"):
        whiten(spark.createDataFrame([(1, [1e10, 0.0]), (2, [0.0, 1.0])], SCHEMA)).collect()


def test_products_are_exact():
    random = np.random.default_rng(1)
    for size in (10, 10**6, 2**27):
        rows = random.integers(-size, size, (30, 4))
        exact = [[sum(int(a) * int(b) for a, b in zip(rows[:, i], rows[:, j], strict=True)) for j in range(4)] for i in range(4)]
        assert exact_products(rows).tolist() == exact
    assert [round_half(t, 4) for t in (-6, -5, -1, 0, 1, 2, 7)] == [-1, -1, 0, 0, 0, 1, 2]
