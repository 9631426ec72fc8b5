"""Plans over business tables in Parquet files."""

from __future__ import annotations

import datetime
import re
import tempfile

import pytest

import sievecraft
from sievecraft import RULES, from_database, from_folder

AS_OF = datetime.date(2001, 8, 1)
ANTI = "BOM-01 BOM-02 BOM-13 BOM-14 SUP-11 SUP-12 SUP-13 ITM-02 ITM-09 SAL-04 STK-03".split()


def plan(df, mode="formatted") -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.fixture(scope="module")
def tables(spark, business_folder):
    return from_folder(spark, business_folder)


@pytest.fixture(scope="module")
def planned(tables):
    return {rule_id: plan(sievecraft.check(rule_id, tables, AS_OF)) for rule_id in RULES}


@pytest.mark.parametrize("rule_id", list(RULES))
def test_no_product_and_no_python(planned, rule_id):
    text = planned[rule_id]
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas", text)
    # One task joins the words of a table of bits, a fixed number, and nothing else.
    gathered = [match.start() for match in re.finditer("SinglePartition", text)]
    assert not gathered or text.index("===== Subqueries =====") < gathered[0]
    assert len(gathered) == text.count("Functions [1]: [partial_collect_list(struct(word")


@pytest.mark.parametrize("rule_id", ANTI)
def test_missing_references_are_anti_joins(planned, rule_id):
    assert "LeftAnti" in planned[rule_id]
    assert "LeftOuter" not in planned[rule_id] or rule_id == "STK-03"


def test_latest_row_is_limited_before_the_shuffle(planned):
    assert len(re.findall(r"WindowGroupLimit \(\d+\)\n", planned["STK-01"])) == 2


def test_impossible_condition_reads_nothing(planned):
    assert "Scan parquet" not in planned["BOM-11"]
    assert "LocalTableScan" in planned["BOM-11"]


@pytest.mark.parametrize(
    "rule_id, pushed",
    [
        ("SUP-01", "EqualTo(PrcrmntMtd,B)"),
        ("SUP-01", "Or(IsNull(CardCode),EqualTo(CardCode,))"),
        ("SUP-06", "Or(IsNull(LeadTime),EqualTo(LeadTime,0))"),
        ("SUP-09", "Or(IsNull(GroupNum),EqualTo(GroupNum,-1))"),
        ("BOM-03", "EqualTo(validFor,N)"),
        ("BOM-04", "Or(IsNull(Quantity),LessThanOrEqual(Quantity,0"),
        ("BOM-12", "Or(IsNull(Qauntity),LessThanOrEqual(Qauntity,0"),
        ("PUR-04", "In(PrcrmntMtd, [M,P])"),
        ("ITM-14", "LessThan(UpdateDate,1999-08-01)"),
        ("SAL-A2", "EqualTo(PriceList,1)"),
        ("STK-01", "EqualTo(TransType,59)"),
        ("STK-02", "LessThan(OnHand,0"),
        ("STK-04", "GreaterThanOrEqual(DocDate,2001-05-03)"),
    ],
)
def test_filters_reach_the_scan(planned, rule_id, pushed):
    assert any(pushed in line for line in planned[rule_id].splitlines() if "PushedFilters" in line)


@pytest.mark.parametrize(
    "rule_id, table, columns",
    [
        ("ITM-20", "OINM", "DocDate,ItemCode,Warehouse"),  # by warehouse, to share the shuffle of STK-06
        ("SUP-02", "POR1", "CardCode,ItemCode"),
        ("STK-06", "OINM", "DocDate,ItemCode,Warehouse"),
        ("BOM-02", "ITT1", "Father"),
        ("SAL-04", "ITM1", "ItemCode"),
    ],
)
def test_scans_read_the_needed_columns_only(planned, rule_id, table, columns):
    scans = re.findall(r"Location: \S* ?\[[^\]]*/(\w+)\].*?ReadSchema: struct<([^>]*)>", planned[rule_id], re.S)
    assert columns in {
        ",".join(sorted(field.split(":")[0] for field in fields.split(","))) for name, fields in scans if name == table
    }


def test_facts_are_reduced_before_they_are_joined(planned):
    for rule_id in ("ITM-20", "STK-06", "SUP-02"):
        tree = planned[rule_id].split("\n\n")[0]
        assert tree.rindex("Aggregate") > tree.index("Join")


def test_the_pack_reads_each_source_once(tables):
    row_rules = [rule_id for rule_id, found in RULES.items() if isinstance(found, sievecraft.RowRule)]
    pack = plan(sievecraft.findings(tables, AS_OF, row_rules), "simple")
    sources = {RULES[rule_id].source.name: RULES[rule_id].source for rule_id in row_rules}
    assert len(row_rules) > 40 and len(sources) < 10
    assert pack.count("FileScan parquet") <= 1 + sum(len(source.tables) for source in sources.values())


def test_bucketed_tables_are_joined_without_a_shuffle(spark, configured, business_folder):
    configured(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__sources__bucketing__autoBucketedScan__enabled="true")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    for name in ("OITM", "OITW"):
        table = spark.read.parquet(f"{business_folder}/{name}")
        table.write.bucketBy(8, "ItemCode").sortBy("ItemCode").option("path", f"{folder}/{name}").mode(
            "overwrite"
        ).saveAsTable(f"bucketed.{name}")
    found = sievecraft.check("STK-02", from_database(spark, "bucketed"), AS_OF)
    assert "SortMergeJoin" in plan(found) and "Exchange" not in plan(found)
    assert found.count() == 250
    spark.sql("DROP DATABASE bucketed CASCADE")


@pytest.mark.parametrize(
    "rule_id, most",
    [
        ("SUP-02", 3), ("ITM-20", 3), ("STK-06", 7), ("STK-03", 7), ("STK-01", 5), ("BOM-02", 5), ("BOM-15", 7), ("SUP-11", 3), ("SUP-13", 3), ("SAL-04", 4), ("ITM-07", 3), ("ITM-21", 4),
        ("BOM-15-depth", 14),
    ],
)
def test_exchanges(configured, tables, rule_id, most):
    """What a check may shuffle where nothing is broadcast; SAL-04 with its sort."""
    configured(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    found = plan(sievecraft.check(rule_id, tables, AS_OF), "simple")
    assert len(re.findall(r"\bExchange ", found)) <= most


def node(text: str, number: str) -> str:
    """The details of a numbered operator of a formatted plan."""
    return re.search(rf"\n\({number}\) [^\n]*\n.*?(?=\n\n|\Z)", text, re.S)[0]


@pytest.mark.parametrize("rule_id", ["BOM-08", "SUP-08"])
def test_only_repeated_keys_are_laid_out(planned, rule_id):
    """Rows are tested against the bits of the keys that repeat before anything of them is shuffled; no join follows."""
    text = planned[rule_id]
    tree = text.split("\n\n")[0].split("===== Subqueries")[0]
    assert "Join" not in tree and "getbit" in text
    last = re.findall(r"(\w+) (?:\w+ )*\((\d+)\)", tree)
    above = [number for name, number in last if name == "Filter"]
    assert any("getbit" in node(text, number) for number in above)
    assert text.index("rangepartitioning") > 0


@pytest.mark.parametrize("rule_id, table, key", [("BOM-13", "ITT1", "Father"), ("BOM-14", "ITT1", "Code")])
def test_rows_with_a_reference_are_not_shuffled(planned, rule_id, table, key):
    """A scan of the fact table is followed by making its keys distinct in the map task, or by the table of bits."""
    nodes = [text for text in planned[rule_id].split("\n\n") if text.lstrip("\n").startswith("(")]
    scans = [text for text in nodes if "Scan parquet" in text and re.search(rf"/{table}\b", text)]
    keys = [re.search(rf"\b{key}#\d+", text)[0] for text in scans if re.search(rf"\b{key}#", text)]
    tested = [k for k in keys if any("getbit(" in text and f"xxhash64({k}, 42)" in text for text in nodes)]
    reduced = [k for k in keys if any("HashAggregate" in text and f"Keys [1]: [{k}]" in text and "Functions: []" in text for text in nodes)]
    assert tested and reduced and set(tested) | set(reduced) == set(keys)
