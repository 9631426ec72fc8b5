"""Reading the business tables."""

from __future__ import annotations

import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

import sievecraft
from sievecraft.sources import SCHEMAS, DerivedTables, SchemaMismatch, conform, from_database, from_folder
from conftest import TESTDATA

AS_OF = datetime.date(2001, 8, 1)


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_derived_tables_have_the_declared_columns(spark, name):
    table = DerivedTables(spark, str(TESTDATA / "sf0.001"))[name]
    assert conform(table, SCHEMAS[name], name).columns == [field.name for field in SCHEMAS[name].fields]


def test_conform_reports_and_casts(spark):
    schema = SCHEMAS["OCPR"]
    narrow = spark.createDataFrame([("c",)], "CardCode string")
    with pytest.raises(SchemaMismatch, match="CntctCode"):
        conform(narrow, schema, "OCPR")
    odd = spark.createDataFrame([("c", "7", 1)], "cardcode string, CNTCTCODE string, other int")
    with pytest.raises(SchemaMismatch, match="string found, int declared"):
        conform(odd, schema, "OCPR")
    assert conform(odd, schema, "OCPR", cast=True).collect() == [("c", 7)]


def test_unknown_tables(spark):
    with pytest.raises(KeyError):
        DerivedTables(spark, str(TESTDATA / "sf0.001"))["NONE"]
    with pytest.raises(KeyError):
        from_folder(spark, "/nowhere")["NONE"]


@pytest.mark.parametrize("fmt, options", [("parquet", {}), ("orc", {}), ("csv", {"header": "true"}), ("json", {})])
def test_checks_run_from_files(spark, fmt, options):
    derived = DerivedTables(spark, str(TESTDATA / "sf0.001"))
    folder = tempfile.mkdtemp(prefix="run-")
    for name in ("OITM", "OITT"):
        conform(derived[name], SCHEMAS[name]).write.format(fmt).options(**options).mode("overwrite").save(
            f"{folder}/{name}"
        )
    tables = from_folder(spark, folder, fmt, **options)
    assert sievecraft.check("ITM-09", tables, AS_OF).count() == 16


def test_checks_run_from_views(spark):
    derived = DerivedTables(spark, str(TESTDATA / "sf0.001"))
    for name in ("OITM", "ITT1"):
        derived[name].withColumn("not_declared", F.lit(1)).createOrReplaceTempView(name)
    tables = from_database(spark)
    assert "not_declared" not in tables["OITM"].columns
    assert sievecraft.check("BOM-03", tables, AS_OF).count() == 239


def test_few_files_of_many_rows_are_spread(spark):
    """A scan of two uneven tasks would make the derived rows in two; one of a single task is left alone."""
    folder = tempfile.mkdtemp(prefix="run-")
    given = spark.read.parquet(str(TESTDATA / "sf0.01" / "part.parquet"))
    uneven = given.repartitionByRange(2, F.col("p_partkey") < 100)
    uneven.write.parquet(f"{folder}/part.parquet")
    for name in ("OITM", "OITW", "ITT1"):
        tables, plain = DerivedTables(spark, folder), DerivedTables(spark, str(TESTDATA / "sf0.01"))
        sizes = tables[name].groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == spark.sparkContext.defaultParallelism
        assert max(row["count"] for row in sizes) < plain[name].count() / 4
        assert tables[name].exceptAll(plain[name]).isEmpty() and plain[name].exceptAll(tables[name]).isEmpty()
    assert plain["OITM"].rdd.getNumPartitions() == 1
