"""Divergence of sources: against SQL on odd rows, many blocks, and exact whole numbers."""

from __future__ import annotations

from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from compare import rows_of_duck, rows_of_spark
from conftest import TESTDATA
from sievecraft.llm import divergence
from sievecraft.llm.divergence import _share, differences, source_divergence
from sievecraft.llm.queries import DIVERGENCE, op13_source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"
ODD = [
    *[(k, f"Alpha beta{k % 3} gamma-delta ÄÖ {'x ' * k}", "en", f"s{k % 4}", 0) for k in range(40)],
    *[(k, "alpha ALPHA été 日本 _1_", None, None, 0) for k in range(12)],
    *[(k, None, "en", "s9", 0) for k in range(3)],
    (None, "", "en", None, 0), (7, "only few words", "de", "s1", 0), (7, "only few words", "de", "s2", 0), (8, None, "fr", "s1", 0),
    (9, "long " * 60_000, "en", "s1", 0),
]


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return rows_of_duck(con, DIVERGENCE)


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 3), (1, 1)])
def test_odd_documents(spark, blocks):
    docs = spark.createDataFrame(ODD, SCHEMA)
    found = source_divergence(docs.repartition(3), group_block=blocks[0], term_block=blocks[1])
    assert rows_of_spark(found) == by_sql(docs.toArrow())


def test_documents_of_a_table(spark):
    found = rows_of_spark(op13_source_divergence(spark, str(TESTDATA / "sf0.01")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{TESTDATA / 'sf0.01/documents.parquet'}'")
    assert found == rows_of_duck(con, DIVERGENCE)


def test_no_documents_and_other_columns(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame(ODD, SCHEMA)
    named = docs.selectExpr("*", "1 AS n", "'x' AS term", "2 AS p", "3 AS rank", "4 AS item", "5 AS l", "6 AS group_id")
    assert rows_of_spark(source_divergence(named)) == rows_of_spark(source_divergence(docs))


def test_a_language_with_one_source_and_one_without_terms(spark):
    rows = [(k, "same words here", "aa", "only", 0) for k in range(10)] + [(k, "12 34", "bb", f"s{k}", 0) for k in range(3)]
    found = source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.lang, r.part, r.value) for r in found} == {("bb", "pair", 0)}
    assert sorted((r.source, r.item, r["rank"]) for r in found) == [
        ("s0", "s1", 1), ("s0", "s2", 2), ("s1", "s0", 1), ("s1", "s2", 2), ("s2", "s0", 1), ("s2", "s1", 2),
    ]


def test_shares_are_exact(spark):
    random = np.random.default_rng(2)
    totals = random.integers(1, 9 * 10**15, 500)
    counts = [int(random.integers(0, max(1, t - 2))) for t in totals] + [0, 0]
    totals = [*totals.tolist(), 2, 9 * 10**15]
    frame = spark.createDataFrame(list(zip(counts, totals, strict=True)), "n long, total long")
    found = frame.selectExpr("n", "total", f"{_share('n', 'total')} AS p").collect()
    assert all(r.p == 1 + int(Fraction(10**9 * (r.n + 2), r.total)) for r in found)


def test_differences_are_exact():
    p, q = np.array([10**9 + 1, 1, 7, 0]), np.array([1, 10**9 + 1, 7, 0])
    exact = [(int(a) - int(b)) ** 2 // max(1, int(a) + int(b)) for a, b in zip(p, q, strict=True)]
    assert differences(p, q).tolist() == exact


def test_counts_pass_on_before_they_grow(monkeypatch):
    """A task that holds few terms at a time counts the same."""
    monkeypatch.setattr(divergence, "_HELD", 5)
    texts = [f"x x y{chr(0x100 + k // 2)}".encode() for k in range(200)]
    rows = list(divergence.count_terms(iter([pa.record_batch({"lang": ["a"] * 200, "source": ["b"] * 200, "text": texts})])))
    counted = pa.Table.from_batches(rows).to_pandas().groupby("term")[["n", "docs"]].sum()
    assert len(rows) > 1 and len(counted) == 101
    assert counted.loc[b"x"].tolist() == [400, 200] and (counted.drop([b"x"]) == 2).all().all()
