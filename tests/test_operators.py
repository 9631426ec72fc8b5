"""Operators on hand-made rows."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sievecraft.operators import hierarchy
from sievecraft.operators import (
    attach, bits_of, cardinality, compare, copies, cycle_members, deeper_than, duplicates, in_order, latest, may_hold, missing, orphans,
    rare_orphans, self_loops, stale, status_conflict,
)


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture
def left(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")


@pytest.fixture
def right(spark):
    return spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z"), (None, "n")], "code string, w string")


def test_missing(spark):
    df = spark.createDataFrame([(None, 0), ("x", -1), ("x", 5)], "t string, n int")
    assert rows(missing(df, "t")) == [(None, 0)]
    assert rows(missing(df, "n", codes=(-1, 0))) == [("x", -1), (None, 0)]
    assert rows(missing(df, "n", kind="not_positive")) == [("x", -1), (None, 0)]


def test_compare_drops_null_and_measures(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (None, 1)], "a int, b int")
    assert rows(compare(df, F.col("a") > F.col("b"), over=F.col("a") - F.col("b"))) == [(2, 1, 1)]


def test_attach_keeps_and_repeats(left, right):
    assert rows(attach(left, right, {"k": "code"}, w="w")) == [
        ("a", 1, "x"), ("a", 1, "y"), ("b", 2, None), ("b", 3, None), (None, 4, None),
    ]
    assert rows(attach(left, right, {"k": "code"}, "inner", w="w")) == [("a", 1, "x"), ("a", 1, "y")]


def test_orphans_and_matches_partition_the_rows(left, right):
    lost = orphans(left, right, {"k": "code"})
    assert rows(lost) == [("b", 2), ("b", 3), (None, 4)]
    assert lost.count() + left.join(right, left.k == right.code, "left_semi").count() == left.count()


def test_orphans_with_residual(spark):
    items = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 1)], "g int, base int")
    units = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 5)], "g int, unit int")
    assert rows(orphans(items, units, {"g": "g"}, residual=F.col("unit") != F.col("base"))) == [
        (2, 1), (3, None), (None, 1),
    ]


def test_status_conflict(left, spark):
    status = spark.createDataFrame([("a", "N"), ("b", "Y"), ("b", "N")], "code string, active string")
    assert rows(status_conflict(left, status, {"k": "code"}, F.col("active") == "N", active="active")) == [
        ("a", 1, "N"), ("b", 2, "N"), ("b", 3, "N"),
    ]


def test_duplicates(spark):
    df = spark.createDataFrame(
        [("A", "2"), ("a", "1"), ("a", "1"), ("b", "9"), (None, "7"), (None, None)], "n string, c string"
    )
    assert rows(duplicates(df, {"name": F.upper("n")}, "hits")) == [("A", 3), (None, 2)]
    listed = duplicates(df, {"name": F.upper("n")}, "hits", {"codes": "c"})
    assert rows(listed.select("name", "hits", "codes")) == [("A", 3, "1, 1, 2"), (None, 2, "7")]


def test_duplicates_without_any_member(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "n string, c string")
    assert rows(duplicates(df, {"n": F.col("n")}, "hits", {"codes": "c"})) == [("a", 2, None)]


def test_member_lists_of_a_group_spread_over_partitions(spark):
    members = spark.range(20_000).selectExpr("'hot' AS n", "lpad(id, 6, '0') AS c").union(
        spark.range(50).selectExpr("concat('n', id % 25) AS n", "lpad(id, 6, '0') AS c")
    )
    found = {r.n: (r.hits, r.codes) for r in duplicates(members, {"n": F.col("n")}, "hits", {"codes": "c"}).collect()}
    assert len(found) == 26
    assert found["hot"] == (20_000, ", ".join(f"{i:06d}" for i in range(20_000)))
    assert found["n3"] == (2, "000003, 000028")


def test_copies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(copies(df, "a", "b")) == [(1, None, 2), (2, "x", 1)]


def test_cardinality(spark):
    parents = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    details = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", None), (None, "x")], "k string, d string"
    )
    distinct = {"n": F.count_distinct("d")}
    assert rows(cardinality(parents, details, {"k": "k"}, distinct, high=1)) == [("b", 1), ("c", 0), (None, 0)]
    assert rows(cardinality(parents, details, {"k": "k"}, distinct, low=1, high=1)) == [("b", 1)]
    assert rows(cardinality(parents, details, {"k": "k"}, distinct, low=2)) == [("a", 2)]
    # Counted per copy: two equal parents with two details each count four.
    plain = {"n": F.count("d")}
    assert rows(cardinality(parents, details, {"k": "k"}, plain, low=2, per_copy=True)) == [("a", 4), ("b", 2)]
    assert rows(cardinality(parents, details, {"k": "k"}, plain, high=2, per_copy=True)) == [
        ("b", 2), ("c", 0), (None, 0),
    ]


def test_stale(spark):
    day = datetime.date
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    facts = spark.createDataFrame(
        [("a", day(2000, 1, 1)), ("a", day(2001, 1, 1)), ("b", day(2000, 7, 31)), ("c", day(2000, 8, 1))],
        "code string, d date",
    )
    found = stale(items, facts, {"k": "code"}, "d", F.lit(day(2000, 8, 1)), "last")
    assert rows(found) == [("b", day(2000, 7, 31)), ("d", None)]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 2, 4), ("b", None, 1)], "k string, d int, q int")
    newest = latest(df, ["k"], [F.col("d").desc_nulls_last(), F.col("q").desc_nulls_last()])
    assert rows(newest) == [("a", 2, 4), ("b", None, 1)]


def test_self_loops(spark):
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None)], "p string, c string")
    assert rows(self_loops(edges, "p", "c")) == [("a", "a")]


def test_in_order(spark):
    df = spark.createDataFrame([(1, "b"), (None, "c"), (2, "z"), (2, "a")], "n int, t string")
    assert [tuple(r) for r in in_order(df, {"n": "desc"}).collect()] == [(2, "a"), (2, "z"), (1, "b"), (None, "c")]
    assert [r.n for r in in_order(df, {"n": "asc"}).collect()] == [None, 1, 2, 2]


GRAPHS = {
    "chain": [("a", "b"), ("b", "c"), ("c", "d")],
    "loop": [("a", "a"), ("a", "b")],
    "ring": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")],
    "bridge": [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "x")],
    "bridge against the order": [("x", "y"), ("y", "x"), ("y", "m"), ("m", "a"), ("a", "b"), ("b", "a")],
    "two rings on one node": [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f")],
}


def below(edges):
    """Nodes to the nodes some path leads to."""
    found = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        wider = {a: seen | {c for b in seen for c in found.get(b, ())} for a, seen in found.items()}
        if wider == found:
            return found
        found = wider


def depth_over(edges, node, levels):
    layer = {node}
    for _ in range(levels + 1):
        layer = {b for a, b in edges if a in layer}
    return bool(layer)


@pytest.fixture(scope="module")
def graphs():
    """The named graphs and random ones, with node names of their own."""
    draw = random.Random(5)
    found = dict(GRAPHS)
    for size in range(3, 11):
        for density in (1.0, 1.3, 2.0):
            nodes = [f"{i:02d}" for i in range(size)]
            found[f"random {size} {density}"] = [
                (draw.choice(nodes), draw.choice(nodes)) for _ in range(int(size * density))
            ]
    return [(f"{name}/{a}", f"{name}/{b}") for name, edges in found.items() for a, b in edges]


def test_cycle_members(spark, graphs):
    df = spark.createDataFrame(graphs + [("gap", None), (None, "gap")], "p string, c string")
    expected = sorted(node for node, seen in below(graphs).items() if node in seen)
    assert [node for (node,) in rows(cycle_members(df, "p", "c"))] == expected


def chained(edges, draw, longest):
    """The graph with some links stretched to chains."""
    found = []
    for n, (a, b) in enumerate(edges):
        inner = [f"{a}-{b}-{n}-{k}" for k in range(draw.choice([0, 0, 1, 2, longest]))]
        found += list(zip([a, *inner], [*inner, b], strict=True))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_cycles_with_long_chains(spark, seed):
    draw = random.Random(seed)
    edges = []
    for g in range(12):
        nodes = [f"{g}/{i:02d}" for i in range(draw.randint(2, 9))]
        own = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(int(len(nodes) * draw.choice([1.0, 1.4, 2.0])))]
        edges += chained(own, draw, 9)
    df = spark.createDataFrame(edges, "p string, c string")
    expected = sorted(node for node, seen in below(edges).items() if node in seen)
    assert [node for (node,) in rows(cycle_members(df, "p", "c"))] == expected


def test_rounds_grow_with_the_logarithm_of_a_ring(spark, monkeypatch):
    """A ring of 10,000 nodes with a path in and a path out, and rings that share a node."""
    stored, taken = hierarchy._stored, []

    def counted(*given):
        taken.append(1)
        return stored(*given)

    monkeypatch.setattr(hierarchy, "_stored", counted)
    n = 10_000
    ring = [(k, (k + 1) % n) for k in range(n)]
    paths = [(k, k + 1) for k in range(n, n + 3000)] + [(n + 3000, 0), (5, 2 * n)] + [(k, k + 1) for k in range(2 * n, 2 * n + 3000)]
    eight = [(3 * n + k, 3 * n + (k + 1) % 500) for k in range(500)] + [(3 * n, 4 * n), (4 * n, 4 * n + 1), (4 * n + 1, 3 * n)]
    plain = {"ring": (ring, n), "all": (ring + paths + eight, n + 502)}
    for edges, expected in plain.values():
        taken.clear()
        found = {r.node for r in cycle_members(spark.createDataFrame(edges, "p int, c int"), "p", "c").collect()}
        assert len(found) == expected and found <= set(range(n)) | set(range(3 * n, 3 * n + 500)) | {4 * n, 4 * n + 1}
        assert len(taken) < 40


def test_no_cycle_members(spark):
    df = spark.createDataFrame(GRAPHS["diamond"], "p string, c string")
    assert rows(cycle_members(df, "p", "c")) == []
    assert rows(cycle_members(df.limit(0), "p", "c")) == []


@pytest.mark.parametrize("levels", [0, 2, 4])
def test_deeper_than(spark, graphs, levels):
    df = spark.createDataFrame(graphs, "p string, c string")
    expected = sorted({a for a, _ in graphs if depth_over(graphs, a, levels)})
    assert [node for (node,) in rows(deeper_than(df, "p", "c", levels))] == expected


def test_table_of_bits(spark):
    keys = spark.createDataFrame([("a", 1), (None, 2), ("b", None), ("a", 1)], "k string, n int")
    rows_ = spark.createDataFrame([("a", 1), ("a", 2), (None, 2), ("b", None), (None, None), ("c", 7)], "k string, n int")
    assert rows(rows_.filter(may_hold(bits_of(keys), "k", "n"))) == [("a", 1), ("b", None), (None, 2)]
    assert rows(rows_.filter(may_hold(bits_of(keys.limit(0)), "k", "n"))) == []


def test_a_full_table_of_bits_loses_nothing(spark):
    keys = spark.range(400_000)
    assert keys.filter(may_hold(bits_of(keys), "id")).count() == 400_000
    others = spark.range(400_000, 800_000).filter(may_hold(bits_of(keys), "id")).count()
    assert 80_000 < others < 160_000


@pytest.mark.parametrize("how", [orphans, rare_orphans])
def test_orphans_by_rows_and_by_keys(spark, how):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 2), (None, 1, 3), ("b", None, 4), ("a", 2, 1)], "x string, y int, v int")
    ref = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", None)], "x string, z int")
    on = {"x": "x", "y": "z"}
    assert rows(how(df, ref, on)) == [("a", 2, 1), ("a", 2, 1), ("b", 1, 2), ("b", None, 4), (None, 1, 3)]
    assert rows(how(df, ref.limit(0), on)) == rows(df)
    assert rows(how(df.limit(0), ref, on)) == []
    # Nothing is lost where key types differ.
    assert rows(how(df, ref.withColumn("z", F.col("z").cast("bigint")), on)) == rows(how(df, ref, on))


@pytest.mark.parametrize("kind", ["string", "int", "bigint", "date", "decimal(9,2)", "double", "binary"])
def test_attach_to_grouped_rows_of_any_type(spark, kind):
    value = "date_add(DATE'2001-01-01', CAST(id % 5 AS int))" if kind == "date" else f"CAST(CAST(id % 5 AS string) AS {kind})"
    df = spark.range(20).select(F.expr(value).alias("k"), "id")
    totals = df.where("id % 5 < 4").groupBy("k").count()
    found = attach(df, totals, {"k": "k"}, grouped=True, n="count")
    assert found.columns == ["k", "id", "n"]
    assert [row.n for row in found.orderBy("id").collect()] == [4, 4, 4, 4, None] * 4
