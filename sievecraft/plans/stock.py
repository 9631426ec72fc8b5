"""Checks of stock and stock movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, blank, days_before, days_since, difference, label, or_zero, percentage, rounded_product
from ..operators import attach, compare, latest, orphans, stale
from .constants import IDLE_STOCK_DAYS, MOVEMENT_TYPES, NEVER_MOVED, OTHER_MOVEMENT, RECENT_DAYS, STOCK_COUNT, YES
from .items import WAREHOUSE_STOCK, newest_movements
from .rule import INCONSISTENT, MISSING, TableMap, row_rule, rule


def active_items(t: TableMap) -> DataFrame:
    return t["OITM"].filter(F.col("validFor") == YES)


def stock_in_hand(t: TableMap) -> DataFrame:
    return t["OITW"].filter(F.col("OnHand") > 0).select("ItemCode", "WhsCode", "OnHand")


def named(rows: DataFrame, items: DataFrame, **more: str) -> DataFrame:
    """Rows of existing items, with the item's name."""
    return attach(rows, items, {"ItemCode": "ItemCode"}, "inner", ItemName="ItemName", **more)


@rule("STK-01", INCONSISTENT, "Stock on hand differs from the latest stock count", "OITM OITW OINM", "ItemCode WhsCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    counts = t["OINM"].filter(F.col("TransType") == STOCK_COUNT).select("ItemCode", "Warehouse", "InQty", "DocDate")
    # Counts of one day have no order of their own; the larger quantity decides.
    newest = latest(
        counts, ["ItemCode", "Warehouse"], [F.col("DocDate").desc_nulls_last(), F.col("InQty").desc_nulls_last()]
    )
    stock = attach(
        t["OITW"].filter(F.col("OnHand").isNotNull()), newest,
        {"ItemCode": "ItemCode", "WhsCode": "Warehouse"}, grouped=True, Counted="InQty",
    ).withColumn("DernierInventaire", or_zero("Counted"))
    return named(
        compare(stock, F.col("OnHand") != F.col("DernierInventaire"), Ecart=difference("OnHand", "DernierInventaire")),
        t["OITM"],
    ).select("ItemCode", "ItemName", "WhsCode", "OnHand", "DernierInventaire", "Ecart")


row_rule(
    "STK-02", INCONSISTENT, "Negative stock", WAREHOUSE_STOCK,
    lambda as_of: F.col("OnHand") < 0, ("ItemCode", "ItemName", "WhsCode", "OnHand"), key="ItemCode WhsCode",
)


@rule("STK-03", MISSING, "Stock without a bin", "OITM OITW OIBQ OBIN", "ItemCode WhsCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    # Stock is fine when its item and warehouse have bin rows and each leads to a
    # bin, or bins, that all have a code. Rows are made distinct on both sides
    # before they meet, so equal rows are not paired with each other.
    bins = t["OBIN"].groupBy("AbsEntry").agg(F.bool_and(~blank("BinCode")).alias("coded"))
    placed = (
        attach(t["OIBQ"], bins, {"BinAbs": "AbsEntry"}, grouped=True, coded="coded")
        .groupBy("ItemCode", "WhsCode")
        .agg(F.bool_and(F.coalesce("coded", F.lit(False))).alias("located"))
        .filter("located")
    )
    loose = orphans(stock_in_hand(t), placed, {"ItemCode": "ItemCode", "WhsCode": "WhsCode"}, hot=False)
    # Made distinct again after the join, which needs no shuffle then: items meet few rows.
    return named(loose.distinct(), active_items(t)).select("ItemCode", "ItemName", "WhsCode", "OnHand").distinct()


@rule(
    "STK-04", INCONSISTENT, "Recent movements without a net inflow", "OITM OINM", "ItemCode DocNum WhsCode TransType",
    {"DocDate": "desc"},
)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    net = difference("InQty", "OutQty")
    recent = t["OINM"].filter(F.col("DocDate") >= days_before(as_of, RECENT_DAYS))
    return named(compare(recent, net <= 0, QuantiteNette=net), t["OITM"]).select(
        "ItemCode", "ItemName", F.col("Warehouse").alias("WhsCode"), F.col("BASE_REF").alias("DocNum"), "DocDate",
        "QuantiteNette", "TransType", label("TransType", MOVEMENT_TYPES, OTHER_MOVEMENT).alias("TypeDocument"),
    )


row_rule(
    "STK-05", INCONSISTENT, "Committed stock", WAREHOUSE_STOCK,
    lambda as_of: (F.col("validFor") == YES) & (F.col("IsCommited") > 0),
    (
        "ItemCode", "ItemName", "WhsCode", ("QteEngagee", "IsCommited"), ("StockDisponible", "OnHand"),
        ("PourcentageBloque", lambda as_of: percentage("IsCommited", "OnHand")),
    ),
    key="ItemCode WhsCode", order={"QteEngagee": "desc"},
)


@rule(
    "STK-06", INCONSISTENT, "Stock without a movement for a year", "OITM OITW OINM", "ItemCode WhsCode",
    {"JoursSansMouvement": "desc"},
)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    known = F.col("ItemCode").isNotNull() & F.col("WhsCode").isNotNull()
    stock = stock_in_hand(t).withColumn("Place", F.when(known, F.struct("ItemCode", F.col("WhsCode").alias("Warehouse"))))
    idle = stale(
        stock, newest_movements(t), {"Place": "Place"}, "DocDate", days_before(as_of, IDLE_STOCK_DAYS), "moved", hot=False
    ).drop("Place").withColumn("DernierMvt", F.coalesce("moved", F.lit(NEVER_MOVED)))
    items = active_items(t).select("ItemCode", "ItemName", "AvgPrice").distinct()
    return named(idle.distinct(), items, AvgPrice="AvgPrice").select(
        "ItemCode", "ItemName", "WhsCode", "OnHand", "DernierMvt",
        days_since("DernierMvt", as_of).alias("JoursSansMouvement"),
        rounded_product("OnHand", "AvgPrice").alias("ValeurStock"),
    )
