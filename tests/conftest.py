from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TESTDATA = Path("/root/testdata")
GIVEN = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sievecraft-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    yield session
    session.stop()


@pytest.fixture
def configured(spark):
    """Set session options for one test; the old values come back afterwards."""
    before = {}

    def set_options(**options):
        for name, value in options.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_options
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the given tables of one scale."""
    open_connections = {}

    def connect(scale: str):
        if scale not in open_connections:
            con = duckdb.connect()
            for table in GIVEN:
                con.execute(f"CREATE VIEW {table} AS FROM '{TESTDATA / scale / table}.parquet'")
            open_connections[scale] = con
        return open_connections[scale]

    yield connect
    for con in open_connections.values():
        con.close()


# Column of each table that gets one value in a third of all rows.
HOT = {
    "OITM": ("CardCode", "S1"),
    "OCRD": ("CardName", "Dup 9"),
    "OCPR": ("CardCode", "C6"),
    "ITM1": ("ItemCode", "P7"),
    "POR1": ("ItemCode", "P3"),
    "ITM2": ("ItemCode", "P2"),
    "OITW": ("ItemCode", "P8"),
    "OINM": ("ItemCode", "P8"),
    "OIBQ": ("BinAbs", "5"),
    "OITT": ("Code", "P8"),
    "ITT1": ("Code", "P1"),
}


@pytest.fixture(scope="session")
def business_folder(spark):
    """The business tables as Parquet folders of several files."""
    from sievecraft.sources import SCHEMAS, DerivedTables, conform

    folder = tempfile.mkdtemp(prefix="run-")
    derived = DerivedTables(spark, str(TESTDATA / "sf0.01"))
    for name, schema in SCHEMAS.items():
        conform(derived[name], schema, name).repartition(6).write.parquet(f"{folder}/{name}")
    return folder


@pytest.fixture(scope="session")
def hot_folder(spark, business_folder):
    """The business tables with hot keys (see HOT)."""
    from pyspark.sql import functions as F

    from sievecraft.sources import SCHEMAS

    folder = tempfile.mkdtemp(prefix="run-")
    for name, schema in SCHEMAS.items():
        table = spark.read.parquet(f"{business_folder}/{name}")
        if name in HOT:
            column, value = HOT[name]
            hot = F.pmod(F.xxhash64(*table.columns), F.lit(3)) == 0
            table = table.withColumn(
                column, F.when(hot, F.lit(value).cast(schema[column].dataType)).otherwise(F.col(column))
            )
        table.write.parquet(f"{folder}/{name}")
    return folder
