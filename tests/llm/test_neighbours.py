"""Nearest neighbours: recall, exact scores, ties and odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import TESTDATA
from sievecraft.llm import ann
from sievecraft.llm.ann import nearest, search_order, valid_vectors
from sievecraft.llm.queries import op10_nearest_vectors

KIND = "vec_id bigint, embedding array<float>"


def brute(rows, query_id, query, k):
    scores = {i: float(sum(float(a) * float(b) for a, b in zip(v, query, strict=True))) for i, v in rows if i != query_id}
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_recall_and_scores(spark):
    table = spark.read.parquet(str(TESTDATA / "sf0.1/embeddings.parquet")).collect()
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table]
    vectors = dict(rows)
    by_query = {}
    for r in op10_nearest_vectors(spark, str(TESTDATA / "sf0.1")).collect():
        by_query.setdefault(r.query_id, []).append(r)
        assert math.isclose(r.score, float(vectors[r.query_id] @ vectors[r.vec_id]), abs_tol=1e-12)
    assert set(by_query) == {i for i, _ in rows if i % 20 == 0}
    matrix, ids, hits = np.array([v for _, v in rows]), np.array([i for i, _ in rows]), 0
    for query_id, found in by_query.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        scores = np.where(ids == query_id, -np.inf, matrix @ vectors[query_id])
        hits += len({r.vec_id for r in found} & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(by_query)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
        (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5]), (10, [1.0, 0.0]), (11, []),
    ]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND + ", score string")
    vectors = valid_vectors(table)
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 2 and None not in v and all(map(math.isfinite, v)) and any(v)}
    assert {(r.id, tuple(r.vector)) for r in vectors.collect()} == sound
    found = nearest(vectors, vectors.where("id % 20 = 0"), k=3).collect()
    for query_id in (0, 20):
        own = sorted((r for r in found if r.query_id == query_id), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == brute(sound, query_id, dict(sound)[query_id], 3)
    everything = nearest(vectors, vectors.where("id = 9"), k=20).collect()
    assert len(everything) == len({i for i, _ in sound}) - 1


def test_no_vectors(spark):
    none = valid_vectors(spark.createDataFrame([], KIND))
    assert nearest(none, none).count() == 0
    one = valid_vectors(spark.createDataFrame([(0, [1.0, 2.0])], KIND))
    assert nearest(one, one).count() == 0 and nearest(one, one.where("id = 5")).count() == 0


@pytest.mark.parametrize("block", [None, 7])
def test_a_very_common_vector(spark, monkeypatch, block):
    """Copies in any number leave room for ties by id, and blocks of a leaf don't change the result."""
    if block:
        monkeypatch.setattr(ann, "BLOCK", block)
    random = np.random.default_rng(1)
    rows = [(i, [0.6, 0.8, 0.0] if i % 3 else random.normal(size=3).astype(np.float32).tolist()) for i in range(600)]
    vectors = valid_vectors(spark.createDataFrame(rows, KIND).repartition(4))
    plain = [(r.id, tuple(r.vector)) for r in vectors.collect()]
    found = nearest(vectors, vectors.where("id % 60 = 0"), k=5, visits=10_000).collect()
    for query_id in range(0, 600, 60):
        own = sorted((r for r in found if r.query_id == query_id), key=lambda r: r.rank)
        assert [(r.vec_id, pytest.approx(r.score, abs=1e-12)) for r in own] == brute(plain, query_id, dict(plain)[query_id], 5)


def test_search_order_is_one_queue(spark):
    random = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(900, 8)))]
    vectors = valid_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    forest = ann.grow(vectors, trees=4, depth=4)
    sizes = np.full((4, 16), 5)
    query = np.append(random.normal(size=8), 0.0)
    order = list(search_order(query, forest, sizes, 1000, 1))
    assert len(order) == len(set(order)) == 4 * 16

    def priority(tree, leaf):
        node, worst = leaf + 15, -np.inf
        while node:
            up = (node - 1) // 2
            margin = forest.normals[tree, up] @ query - forest.cuts[tree, up]
            worst = max(worst, margin if node == 2 * up + 1 else -margin)
            node = up
        return worst

    found = [priority(*place) for place in order]
    assert found == sorted(found)
    assert list(search_order(query, forest, sizes, 3, 1)) == order[:3]
    assert len(list(search_order(query, forest, sizes, 1, 12))) >= 3
