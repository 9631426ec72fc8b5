"""The business tables, derived from the given TPC-H-like tables.

No business data comes with the repository, so each of the 16 tables is a
projection of a given table, with defects planted by modulus (FIXTURES.md).
``COLUMNS`` is plain SQL that Spark and DuckDB read alike; the row source behind
it is built here with DataFrames and, on its own, in ``oracle`` as SQL, so the
two sides of a comparison share the column text only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column expressions of FIXTURES.md. k is the key of the source row.
COLUMNS: dict[str, dict[str, str]] = {
    "OITM": {
        "ItemCode": "'P' || CAST(CASE WHEN k % 100 = 99 THEN k - 1 ELSE k END AS STRING)",
        "ItemName": (
            "CASE WHEN k % 97 = 0 THEN NULL WHEN k % 97 = 1 THEN '  ' WHEN k % 97 = 2 THEN 'ab'"
            " WHEN k % 97 = 3 THEN ' xy ' WHEN k % 50 = 4 THEN p_name"
            " ELSE p_name || ' ' || CAST(k AS STRING) END"
        ),
        "PrcrmntMtd": (
            "CASE WHEN k % 7 IN (0, 1) THEN 'M' WHEN k % 7 IN (2, 3) THEN 'B'"
            " WHEN k % 7 IN (4, 5) THEN 'P' WHEN k % 2 = 0 THEN NULL ELSE ' ' END"
        ),
        "CardCode": (
            "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN '' WHEN k % 11 = 2 THEN ' '"
            " WHEN k % 11 = 3 THEN 'SX' || CAST(k AS STRING) ELSE 'S' || CAST(k % 10 AS STRING) END"
        ),
        "validFor": "CASE WHEN k % 13 IN (0, 1) THEN 'N' ELSE 'Y' END",
        "SellItem": "CASE WHEN k % 5 = 0 THEN 'N' ELSE 'Y' END",
        "PrchseItem": "CASE WHEN k % 4 = 0 THEN 'N' ELSE 'Y' END",
        "InvntryUom": "CASE WHEN k % 17 = 0 THEN NULL WHEN k % 17 = 1 THEN ' ' ELSE 'EA' END",
        "SalUnitMsr": "CASE WHEN k % 19 = 0 THEN NULL WHEN k % 19 = 1 THEN 'BX' ELSE 'EA' END",
        "BuyUnitMsr": "'EA'",
        "NumInBuy": "CAST(1 AS DECIMAL(19,6))",
        "UgpEntry": "CAST(CASE WHEN k % 23 = 0 THEN NULL ELSE k % 4 + 1 END AS INT)",
        "IUoMEntry": "CAST(1 AS INT)",
        "ItmsGrpCod": (
            "CAST(CASE WHEN k % 29 = 0 THEN NULL WHEN k % 29 = 1 THEN -1 WHEN k % 29 = 2 THEN 0"
            " ELSE 100 + k % 5 END AS INT)"
        ),
        "TaxCodeAP": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 31 = 1 THEN ' ' ELSE 'V20' END",
        "LeadTime": "CAST(CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 0 ELSE p_size END AS INT)",
        "OrdrIntrvl": "CAST(k % 3 AS INT)",
        "MinOrdrQty": "CAST(p_size AS DECIMAL(19,6))",
        "DfltWH": (
            "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 37 = 1 THEN ' '"
            " ELSE 'W' || CAST(k % 25 AS STRING) END"
        ),
        "CodeBars": (
            "CASE WHEN k % 41 = 0 THEN NULL WHEN k % 41 = 1 THEN '' ELSE '40' || CAST(k AS STRING) END"
        ),
        "SWeight1": (
            "CAST(CASE WHEN k % 43 = 0 THEN NULL WHEN k % 43 = 1 THEN 0 ELSE p_size END AS DECIMAL(19,6))"
        ),
        "SHeight1": "CAST(CASE WHEN k % 43 = 2 THEN 0 ELSE 1 END AS DECIMAL(19,6))",
        "SWidth1": "CAST(CASE WHEN k % 43 = 3 THEN NULL ELSE 1 END AS DECIMAL(19,6))",
        "SLength1": "CAST(CASE WHEN k % 43 = 4 THEN 0 ELSE 1 END AS DECIMAL(19,6))",
        "AvgPrice": (
            "CAST(CASE WHEN k % 47 = 0 THEN NULL WHEN k % 47 = 1 THEN 0"
            " ELSE 100 + k % 900 END AS DECIMAL(19,6))"
        ),
        "LastPurPrc": (
            "CAST(CASE WHEN k % 53 = 0 THEN NULL WHEN k % 53 = 1 THEN 0"
            " WHEN k % 8 = 0 THEN 130 + k % 900 * 2 WHEN k % 8 = 1 THEN (100 + k % 900) * 1.2"
            " ELSE 90 + k % 900 END AS DECIMAL(19,6))"
        ),
        "OnHand": "CAST(p_size * 10 AS DECIMAL(19,6))",
        "IsCommited": "CAST(CASE WHEN k % 9 = 0 THEN p_size * 10 + 5 ELSE p_size END AS DECIMAL(19,6))",
        "UpdateDate": "CASE WHEN k % 59 = 0 THEN NULL ELSE DATE '2001-08-01' - CAST(k % 1000 AS INT) END",
    },
    "OCRD": {
        "CardCode": "t || CAST(CASE WHEN k % 50 = 49 THEN k - 1 ELSE k END AS STRING)",
        "CardName": (
            "CASE WHEN k % 10 = 9 THEN UPPER('Dup ' || CAST(k % 20 AS STRING))"
            " WHEN k % 10 = 8 THEN 'Dup ' || CAST((k + 1) % 20 AS STRING) ELSE nm END"
        ),
        "CardType": "t",
        "validFor": "CASE WHEN k % 4 = 3 THEN 'N' ELSE 'Y' END",
        "GroupCode": (
            "CAST(CASE WHEN k % 12 = 0 THEN NULL WHEN k % 12 = 1 THEN -1 WHEN k % 12 = 2 THEN 0"
            " ELSE 100 + k % 3 END AS INT)"
        ),
        "GroupNum": (
            "CAST(CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN -1 WHEN k % 7 = 2 THEN 0"
            " ELSE k % 7 END AS INT)"
        ),
        "ShipType": (
            "CAST(CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN -1 WHEN k % 9 = 2 THEN 0"
            " ELSE k % 9 END AS INT)"
        ),
        "Currency": (
            "CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN '' WHEN k % 8 = 2 THEN ' '"
            " WHEN k % 8 = 4 THEN 'ZZZ' ELSE 'R' || CAST(k % 5 AS STRING) END"
        ),
        "Address": (
            "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '' WHEN k % 5 = 2 THEN '  '"
            " ELSE 'Street ' || CAST(k AS STRING) END"
        ),
        "MailAddres": (
            "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE 'Box ' || CAST(k AS STRING) END"
        ),
        "City": (
            "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN ' '"
            " ELSE 'City ' || CAST(nk AS STRING) END"
        ),
        "Country": (
            "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN '' ELSE 'N' || CAST(nk AS STRING) END"
        ),
        "LicTradNum": (
            "CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN ' ' ELSE 'TX' || CAST(k AS STRING) END"
        ),
        "Phone1": "'+33' || CAST(k AS STRING)",
        "Cellular": "'+336' || CAST(k AS STRING)",
        "E_Mail": "'c' || CAST(k AS STRING) || '@example.com'",
        "Balance": "CAST(bal AS DECIMAL(19,6))",
        "CreditLine": (
            "CAST(CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 1 THEN NULL"
            " ELSE 1000 + k % 4000 END AS DECIMAL(19,6))"
        ),
        "CreateDate": "DATE '2001-08-01' - CAST(k % 3000 AS INT)",
    },
    "OCPR": {
        "CardCode": "t || CAST(k AS STRING)",
        "CntctCode": "CAST(k * 10 + r_regionkey AS INT)",
    },
    "OCRN": {
        "CurrCode": "'R' || CAST(r_regionkey AS STRING)",
    },
    "OITB": {
        "ItmsGrpCod": "CAST(100 + r_regionkey AS INT)",
    },
    "UGP1": {
        "UgpEntry": "CAST(r_regionkey % 3 + 1 AS INT)",
        "UomEntry": "CAST(CASE WHEN r_regionkey < 3 THEN 1 ELSE 2 END AS INT)",
    },
    "OPLN": {
        "ListNum": "CAST(k AS INT)",
        "ListName": "n_name",
        "ValidFrom": "CASE WHEN k % 5 = 0 THEN NULL ELSE DATE '2000-01-01' END",
        "ValidTo": "CASE WHEN k % 3 = 0 THEN NULL ELSE DATE '2001-08-01' + CAST((k - 12) * 10 AS INT) END",
    },
    "ITM1": {
        "ItemCode": "'P' || CAST(k AS STRING)",
        "PriceList": "CAST(r_regionkey + 1 AS INT)",
        "Price": (
            "CAST(CASE WHEN k % 14 = 0 THEN NULL WHEN k % 14 = 1 THEN 0"
            " ELSE 95 + k % 900 + r_regionkey END AS DECIMAL(19,6))"
        ),
        "Currency": "'R' || CAST(k % 5 AS STRING)",
    },
    "POR1": {
        "DocEntry": "l_orderkey",
        "LineNum": "l_linenumber",
        "ItemCode": "'P' || CAST(l_partkey AS STRING)",
        "CardCode": (
            "CASE WHEN l_partkey % 20 < 8 THEN 'S' || CAST(l_partkey % 10 AS STRING)"
            " ELSE 'S' || CAST(l_suppkey AS STRING) END"
        ),
    },
    "ITM2": {
        "ItemCode": "'P' || CAST(l_partkey AS STRING)",
        "CardCode": (
            "CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE CASE"
            " WHEN l_partkey % 20 < 8 THEN 'S' || CAST(l_partkey % 10 AS STRING)"
            " ELSE 'S' || CAST(l_suppkey AS STRING) END END"
        ),
    },
    "OITW": {
        "ItemCode": "'P' || CAST(k AS STRING)",
        "WhsCode": "'W' || CAST(w AS STRING)",
        "MinLevel": (
            "CAST(CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 0 WHEN k % 10 = 2 THEN 90"
            " WHEN k % 10 = 3 THEN 5 + w ELSE 5 END AS DECIMAL(19,6))"
        ),
        "MaxLevel": (
            "CAST(CASE WHEN k % 15 = 4 THEN NULL WHEN k % 15 = 5 THEN 0 ELSE 50 END AS DECIMAL(19,6))"
        ),
        "OnHand": (
            "CAST(CASE WHEN (k + w) % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN -5 WHEN k % 8 = 2 THEN 0"
            " WHEN k % 8 = 3 THEN 1 ELSE p_size * 10 END AS DECIMAL(19,6))"
        ),
        "IsCommited": "CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE p_size END AS DECIMAL(19,6))",
    },
    "OINM": {
        "ItemCode": "'P' || CAST(k AS STRING)",
        "Warehouse": "'W' || CAST((12 - k % 12) % 12 + 12 * (l_linenumber % 2) AS STRING)",
        "TransType": (
            "CAST(CASE l_linenumber WHEN 1 THEN 59 WHEN 2 THEN 13 WHEN 3 THEN 14 WHEN 4 THEN 15"
            " WHEN 5 THEN 20 WHEN 6 THEN 60 ELSE 99 END AS INT)"
        ),
        "BASE_REF": "CAST(l_orderkey AS STRING)",
        "DocDate": "CAST(l_shipdate AS DATE)",
        "InQty": "CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END AS DECIMAL(19,6))",
        "OutQty": "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS DECIMAL(19,6))",
    },
    "OBIN": {
        "AbsEntry": "CAST(k AS INT)",
        "BinCode": (
            "CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN ' ' ELSE 'BIN' || CAST(k AS STRING) END"
        ),
    },
    "OIBQ": {
        "ItemCode": "'P' || CAST(k AS STRING)",
        "WhsCode": "'W' || CAST(w AS STRING)",
        "BinAbs": "CAST(w + 2 AS INT)",
    },
    "OITT": {
        "Code": "'P' || CAST(k AS STRING)",
        "Name": "'v' || CAST(v AS STRING)",
        "TreeType": "CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN ' ' ELSE 'P' END",
        "ToWH": (
            "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN ' ' ELSE 'W' || CAST(k % 25 AS STRING) END"
        ),
        "Qauntity": (
            "CAST(CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 0 WHEN k % 8 = 2 THEN -1"
            " ELSE 1 END AS DECIMAL(19,6))"
        ),
    },
    "ITT1": {
        "Father": "'P' || CAST(k AS STRING)",
        "Code": (
            "CASE WHEN r = 0 THEN 'P' || CAST(CAST((k - k % 2) / 2 AS BIGINT) AS STRING)"
            " WHEN r = 1 THEN 'P' || CAST(CAST((k - k % 3) / 3 AS BIGINT) AS STRING)"
            " WHEN k % 40 = 8 THEN 'P' || CAST(k AS STRING)"
            " WHEN k % 40 = 9 THEN 'PX' || CAST(k AS STRING)"
            " WHEN k % 40 = 10 THEN 'P' || CAST(CAST((k - k % 2) / 2 AS BIGINT) AS STRING) ELSE 'P1' END"
        ),
        "Quantity": (
            "CAST(CASE WHEN (k + r) % 12 = 0 THEN NULL WHEN (k + r) % 12 = 1 THEN 0"
            " WHEN (k + r) % 12 = 2 THEN -1 ELSE (k + r) % 12 END AS DECIMAL(19,6))"
        ),
        "IssueMthd": "CASE WHEN r = 1 THEN 'B' ELSE 'M' END",
    },
}


class DerivedTables(Mapping[str, DataFrame]):
    """Business tables over one folder of given tables, each built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder
        self._built: dict[str, DataFrame] = {}
        self._tasks: dict[str, int] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(COLUMNS)

    def __len__(self) -> int:
        return len(COLUMNS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in COLUMNS:
            raise KeyError(name)
        if name not in self._built:
            rows = getattr(self, f"_{name.lower()}")()
            table = rows.selectExpr(*(f"{text} AS {column}" for column, text in COLUMNS[name].items()))
            self._built[name] = table.distinct() if name == "ITM2" else table
        return self._built[name]

    def _given(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def _spread(self, name: str, key: str) -> DataFrame:
        """A given table with a task for every core, where its files are more than one task's and fewer than that.

        Files are cut by their bytes. Few bytes hold many rows here, of which several are made each, and a row group is one
        task's, so that some tasks would do the work of all.
        """
        rows = self._given(name)
        if name not in self._tasks:
            self._tasks[name] = rows.rdd.getNumPartitions()
        cores = self._spark.sparkContext.defaultParallelism
        return rows.repartition(cores, key) if 1 < self._tasks[name] < cores else rows

    def _parts(self) -> DataFrame:
        return self._spread("part", "p_partkey").withColumn("k", F.col("p_partkey"))

    def _partners(self) -> DataFrame:
        suppliers = self._spread("supplier", "s_suppkey").selectExpr(
            "s_suppkey AS k", "'S' AS t", "s_acctbal AS bal", "s_nationkey AS nk", "s_name AS nm"
        )
        customers = self._spread("customer", "c_custkey").selectExpr(
            "c_custkey AS k", "'C' AS t", "c_acctbal AS bal", "c_nationkey AS nk", "c_name AS nm"
        )
        return suppliers.unionByName(customers)

    def _part_warehouses(self) -> DataFrame:
        # Warehouse w (0 to 24) holds part k when k + w is a multiple of 12. Counting
        # up from the first such w gives the pairs without joining parts to nations.
        return self._parts().withColumn("w", F.expr("explode(sequence((12 - k % 12) % 12, 24, 12))"))

    def _oitm(self) -> DataFrame:
        return self._parts()

    def _ocrd(self) -> DataFrame:
        return self._partners()

    def _ocpr(self) -> DataFrame:
        partners = self._partners().filter("k % 4 > 0")
        return partners.withColumn("r_regionkey", F.expr("explode(sequence(0, k % 4 - 1))"))

    def _ocrn(self) -> DataFrame:
        return self._given("region")

    def _oitb(self) -> DataFrame:
        return self._given("region")

    def _ugp1(self) -> DataFrame:
        return self._given("region")

    def _opln(self) -> DataFrame:
        return self._given("nation").withColumn("k", F.col("n_nationkey"))

    def _itm1(self) -> DataFrame:
        return self._parts().filter("k % 16 <> 5").withColumn("r_regionkey", F.expr("explode(array(0, 1))"))

    def _por1(self) -> DataFrame:
        return self._given("lineitem").filter("l_partkey % 20 <> 3")

    def _itm2(self) -> DataFrame:
        return self._given("lineitem")

    def _oitw(self) -> DataFrame:
        return self._part_warehouses()

    def _oinm(self) -> DataFrame:
        movements = self._given("lineitem").withColumn("k", F.col("l_partkey"))
        return movements.filter(
            "k % 100 <> 5 AND (k % 10 <> 0 OR l_shipdate < TIMESTAMP_NTZ '2000-01-01 00:00:00')"
        )

    def _obin(self) -> DataFrame:
        return self._given("nation").withColumn("k", F.col("n_nationkey"))

    def _oibq(self) -> DataFrame:
        return self._part_warehouses().filter("k % 5 <> 0")

    def _oitt(self) -> DataFrame:
        headers = self._parts().filter("k % 7 IN (0, 1, 2) AND k % 14 <> 0")
        return headers.withColumn("v", F.expr("explode(IF(k % 70 = 8, array(0, 1), array(0)))"))

    def _itt1(self) -> DataFrame:
        fathers = self._parts().filter("NOT (k % 7 = 2 AND k % 3 = 0)")
        return fathers.withColumn("r", F.expr("explode(array(0, 1, 2))"))
