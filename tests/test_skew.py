"""Hot keys: right results, split joins, and no group sorted in one task."""

from __future__ import annotations

import datetime

import duckdb
import pytest

import sievecraft
from compare import rows_of_duck, rows_of_spark
from oracle import STATEMENTS
from sievecraft import RULES, from_folder
from sievecraft.operators import attach, orphans, rare_orphans
from sievecraft.sources import SCHEMAS

AS_OF = datetime.date(2001, 8, 1)
JOINED = [rule_id for rule_id, found in RULES.items() if len(found.tables) > 1] + [
    "BOM-08", "SUP-07", "SUP-08", "SUP-08b", "ITM-04", "ITM-05", "SAL-07", "SAL-A1",
]
SPLIT = ["BOM-03", "BOM-04", "BOM-13", "BOM-15", "SUP-05", "SUP-13", "ITM-11", "STK-01", "STK-04"]
# Keys of the large table are looked up once each; its rows with a reference never reach a join, so there is nothing to split.
KEYS_ONLY = ["BOM-14"]


@pytest.fixture
def shuffled(configured):
    """No broadcast, many small partitions, and skew handling for small sizes."""
    configured(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__files__maxPartitionBytes="16MB",
        spark__sql__files__openCostInBytes="16MB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    )


@pytest.fixture(scope="module")
def hot_duck(hot_folder):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS FROM '{hot_folder}/{name}/*.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("rule_id", JOINED)
def test_right_with_hot_keys(spark, shuffled, hot_folder, hot_duck, rule_id):
    found = sievecraft.check(rule_id, from_folder(spark, hot_folder), AS_OF)
    spark_names, spark_rows = rows_of_spark(found)
    duck_names, duck_rows = rows_of_duck(hot_duck, STATEMENTS[rule_id][1])
    assert spark_names == duck_names
    assert spark_rows == duck_rows
    if rule_id in SPLIT:
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    if rule_id in KEYS_ONLY:
        assert "getbit" in found._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_without_reference_is_split(spark, shuffled):
    lines = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) AS code", "id", "repeat('x', 20) AS filler")
    known = spark.range(1, 500).selectExpr("concat('k', id) AS code")
    found = rare_orphans(lines.repartition(6, "id"), known, {"code": "code"})
    rows = found.select("code", "id").collect()
    assert sorted(row.id for row in rows) == [k for k in range(60_000) if k % 3 == 0 or k % 500 == 0]
    assert _split(found)


def _split(found) -> bool:
    found.collect()
    return "skew=true" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("join", ["attach", "orphans"])
def test_rows_grouped_by_the_key_do_not_keep_a_hot_partition_whole(spark, shuffled, join):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) AS code", "id", "repeat('x', 20) AS filler")
    rows = rows.repartition(6, "id")
    totals = rows.where("code <> 'k7'").groupBy("code").count()
    if join == "attach":
        found = attach(rows, totals, {"code": "code"}, grouped=True, n="count")
        assert found.count() == 60_000 and found.where("n IS NULL").count() == rows.where("code = 'k7'").count()
    else:
        found = orphans(rows, totals, {"code": "code"})
        assert found.count() == rows.where("code = 'k7'").count()
    assert _split(found)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("REBALANCE") == 0
