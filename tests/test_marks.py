"""Mark joins, tagged counts and bounded distinct counts, and the passes that checks share."""

from __future__ import annotations

import datetime
import json
import random
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import sievecraft
from compare import rows_of_duck
from oracle import STATEMENTS
from sievecraft import RULES, from_folder
from sievecraft.operators import Family, Marks, at_most_one, cardinality, found, key_counts, marked
from sievecraft.plans.findings import REPEATS, _repeated, _shares
from sievecraft.plans.rule import KEYED, SHARED, WIDER
from sievecraft.plans.shared import items_with_facts, places
from sievecraft.sources import SCHEMAS
from test_findings import _text
from test_plans import plan

AS_OF = datetime.date(2001, 8, 1)
BROADCASTS_OFF = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [True, False])
def test_marks_of_several_tables(spark, hot):
    items = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), (None, 4)], "code string, v int")
    orders = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "z")], "item string, who string")
    moves = spark.createDataFrame([("a", 5, True), ("a", 9, False), ("c", None, True)], "of string, day int, good boolean")
    given = marked(
        items, {"code": "key"},
        Marks(orders, {"key": "item"}, {"ordered": found(), "first": (F.min, [F.col("who")]), "n": (F.count, [F.col("who")])}),
        Marks(moves, {"key": "of"}, {"last": (F.max, [F.col("day")]), "all_good": (F.bool_and, [F.col("good")]), "which": (F.max_by, [F.col("good"), F.col("day")])}),
        hot=hot,
    )
    assert given.columns == ["code", "v", "ordered", "first", "n", "last", "all_good", "which"]
    a = ("a", 1, True, "x", 2, 9, False, False)
    assert rows(given) == sorted(
        [a, a, ("b", 2, True, None, 0, None, None, None), ("c", 3, None, None, 0, None, True, None), (None, 4, *[None] * 6)], key=repr
    )


def test_marks_by_two_columns(spark):
    places = spark.createDataFrame([("a", "w"), ("a", None), ("b", "w")], "i string, w string")
    stock = spark.createDataFrame([("a", "w"), ("a", None), ("b", "x")], "item string, house string")
    given = marked(places, {"i": "item", "w": "house"}, Marks(stock, {"item": "item", "house": "house"}, {"there": found()}))
    assert rows(given) == [("a", "w", True), ("a", None, None), ("b", "w", None)]


def test_marks_are_one_aggregate_and_one_join(spark, configured):
    configured(**BROADCASTS_OFF)
    tables = [spark.range(100).selectExpr("id AS k", f"id % {n} AS v{n}") for n in range(2, 6)]
    marks = [Marks(t, {"key": "k"}, {f"m{n}": (F.max, [F.col(t.columns[1])])}) for n, t in enumerate(tables)]
    text = plan(marked(spark.range(100), {"id": "key"}, *marks, hot=False), "simple")
    assert len(re.findall(r"\bExchange ", text)) == 2 and text.count("SortMergeJoin") == 1


def test_key_counts(spark):
    one = spark.createDataFrame([("A", 1), ("a", 1), ("b", None), (None, None)], "n string, c int")
    two = spark.createDataFrame([("A",), ("A",)], "n string")
    counted = key_counts(
        (one, [Family("name", [F.upper("n")]), Family("pair", [F.col("n"), F.col("c")], F.col("n").isNotNull())]),
        (two, [Family("two", [F.col("n")], F.col("n") == "A")]),
    )
    assert rows(counted) == sorted(
        [
            ("name", ["A"], 2), ("name", ["B"], 1), ("name", [None], 1), ("two", ["A"], 2),
            ("pair", ["A", "1"], 1), ("pair", ["a", "1"], 1), ("pair", ["b", None], 1),
        ], key=repr,
    )


def test_at_most_one_agrees_with_distinct_counts(spark):
    draw = random.Random(3)
    parents = spark.createDataFrame([(draw.choice("abcdefg"), draw.randint(0, 1)) for _ in range(20)] + [(None, 1)], "k string, v int")
    details = spark.createDataFrame([(draw.choice("abcde"), draw.choice([None, "x", "y"])) for _ in range(9)], "own string, d string")
    distinct = {"n": F.count_distinct("d")}
    for low, none in ((0, True), (1, False)):
        bounded = at_most_one(parents, details, {"k": "own"}, "n", "d", none=none)
        assert rows(bounded) == rows(cardinality(parents, details, {"k": "own"}, distinct, low=low, high=1))
        assert bounded.schema == cardinality(parents, details, {"k": "own"}, distinct, low=low, high=1).schema or none


@pytest.mark.parametrize("rule_id", ["SUP-02", "ITM-07", "ITM-07-none"])
def test_no_pairs_of_item_and_supplier_are_shuffled(spark, configured, business_folder, rule_id):
    configured(**BROADCASTS_OFF)
    text = plan(sievecraft.check(rule_id, from_folder(spark, business_folder), AS_OF), "formatted")
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?), \d+\)", text)
    assert 0 < len(exchanges) <= 3
    assert not [keys for _, keys in exchanges if "ItemCode" in keys and "CardCode" in keys and "ItemName" not in keys]


def test_repeats_of_a_finding(spark):
    given = spark.createDataFrame(
        [("r", "k", None, 1)] * 3 + [("r", "m", None, 2 * REPEATS + 1), ("d", "k", "x", 1), ("d", "k", "x", 5), ("d", "k", "y", 1)],
        "rule_id string, record_key string, __identity string, __times bigint",
    )
    assert Counter(map(tuple, _repeated(given).collect())) == {("r", "k"): 3, ("r", "m"): 2 * REPEATS + 1, ("d", "k"): 2}


def test_which_checks_share():
    passes, counts, alone = _shares(list(RULES.values()))
    assert len(passes) < 12 and {c.rule.rule_id for c in counts} == set(KEYED)
    assert len(alone) <= 6 and not {r.rule_id for r in alone} & set(SHARED)
    # One check of a source is cheaper on its own; with another it shares.
    assert [[r.rule_id for r in part] for part in _shares([RULES["SUP-02"]])[2:]] == [["SUP-02"]]
    passes, _, alone = _shares([RULES["SUP-02"], RULES["BOM-01"]])
    assert not alone and [r.rule_id for r in passes[0][1]] == ["SUP-02", "BOM-01"]
    assert _shares([RULES["ITM-04"]])[1] == [] and len(_shares([RULES["BOM-05"]])[0]) == 1
    assert all(wider.name != name for name, (wider, _) in WIDER.items())


@pytest.mark.parametrize("details", [True, False])
def test_shared_passes_with_hot_keys(spark, configured, hot_folder, details):
    """All checks that share, on tables where one key holds a third of the rows, against DuckDB."""
    configured(**BROADCASTS_OFF, spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB", spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB")
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS FROM '{hot_folder}/{name}/*.parquet'")
    chosen = [r for r, f in RULES.items() if r in SHARED or r in KEYED or (isinstance(f, sievecraft.RowRule) and f.source.name in WIDER)]
    by_rule: dict[str, list] = {}
    for row in sievecraft.findings(from_folder(spark, hot_folder), AS_OF, chosen, details).collect():
        by_rule.setdefault(row.rule_id, []).append(json.loads(row.details, parse_float=Decimal) if details else row.record_key)
    for rule_id in chosen:
        names, expected = rows_of_duck(con, STATEMENTS[rule_id][1])
        if details:
            got = Counter(tuple(_text(d[n]) for n in names) for d in by_rule.get(rule_id, []))
            assert got == Counter({tuple(map(_text, row)): n for row, n in expected.items()}), rule_id
        else:
            assert len(by_rule.get(rule_id, [])) == expected.total(), rule_id


def test_only_texts_are_sorted_for_facts_of_items(spark, business_folder, configured):
    configured(**BROADCASTS_OFF)
    text = plan(items_with_facts(from_folder(spark, business_folder)), "simple")
    sorts = [line for line in text.splitlines() if "SortAggregate" in line]
    assert sorts and any("FirstOrdered" in line for line in sorts)
    assert not any("LastMoved" in line for line in sorts) and not any("max_by" in line for line in text.splitlines())


def test_newest_count_of_a_place(spark, business_folder):
    """The quantity that the largest number of day and quantity holds, at the ends of its range, without a day and without a quantity."""
    tables = dict(from_folder(spark, business_folder))
    day, late, big = datetime.date(1, 1, 1), datetime.date(9999, 12, 31), Decimal("9999999999999.999999")
    stock_counts = [
        ("P1", "W1", None, big), ("P1", "W1", day, -big), ("P2", "W1", late, -big), ("P2", "W1", late, Decimal("-0.000001")),
        ("P3", "W1", day, big), ("P3", "W1", late, None), ("P4", "W1", None, -big), ("P4", "W1", None, None), ("P5", "W1", late, big),
    ]
    kept = tables["OINM"].limit(0)
    moved = spark.createDataFrame(stock_counts, "ItemCode string, Warehouse string, DocDate date, InQty decimal(19,6)")
    tables["OINM"] = kept.unionByName(moved.withColumn("TransType", F.lit(59)), allowMissingColumns=True)
    tables["OITW"] = tables["OITW"].limit(0).unionByName(
        spark.range(1, 7).selectExpr("'P' || id AS ItemCode", "'W1' AS WhsCode"), allowMissingColumns=True
    )
    found_counts = {row.ItemCode: row.Counted for row in places(tables).select("ItemCode", "Counted").collect()}
    assert found_counts == {"P1": -big, "P2": Decimal("-0.000001"), "P3": None, "P4": -big, "P5": big, "P6": None}
