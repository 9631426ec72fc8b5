"""Checks of the item master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, blank, days_since, is_missing, months_before, or_zero
from ..operators import at_most_one, attach, cardinality, duplicates, orphans, stale
from .bom import BOM_HEADERS, MADE_WITHOUT_BOM
from .constants import BOUGHT, IDLE_ITEM_MONTHS, IDLE_MOVEMENT_MONTHS, NO, NO_BARCODE, SHORTEST_NAME, YES
from .rule import DUPLICATE, INCONSISTENT, INVALID, MISSING, Source, TableMap, row_rule, rule

ITEM = ("ItemCode", "ItemName")


def warehouse_stock(t: TableMap) -> DataFrame:
    return attach(t["OITW"], t["OITM"], {"ItemCode": "ItemCode"}, "inner", ItemName="ItemName", validFor="validFor")


def newest_movements(t: TableMap) -> DataFrame:
    """The newest movement of each place, an item in a warehouse.

    Checks that run together share this shuffle. That needs equal plans, so the key is one
    value that is never NULL: Spark would filter a plain warehouse column for some checks only.
    """
    place = F.struct("ItemCode", "Warehouse").alias("Place")
    return t["OINM"].filter(F.col("ItemCode").isNotNull()).groupBy(place).agg(F.max("DocDate").alias("DocDate"))


# Stock by warehouse with the item.
WAREHOUSE_STOCK = Source("warehouse stock", ("OITW", "OITM"), warehouse_stock)


row_rule("ITM-01", MISSING, "Items without an inventory unit", "OITM", lambda as_of: blank("InvntryUom"), (*ITEM, "InvntryUom"))


@rule("ITM-02", MISSING, "Items without a unit other than the inventory unit", "OITM UGP1", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    # A group holds another unit when its lowest or its highest unit is another.
    units = t["UGP1"].groupBy("UgpEntry").agg(F.min("UomEntry").alias("lowest"), F.max("UomEntry").alias("highest"))
    other_unit = (F.col("lowest") != F.col("IUoMEntry")) | (F.col("highest") != F.col("IUoMEntry"))
    return orphans(t["OITM"], units, {"UgpEntry": "UgpEntry"}, residual=other_unit).select(
        *ITEM, "InvntryUom", "UgpEntry", F.lit(None).cast("int").alias("UomEntry")
    )


# A NULL group has no match to look up, so the group table is not read.
row_rule("ITM-03", MISSING, "Items without a group", "OITM", lambda as_of: F.col("ItmsGrpCod").isNull(), (*ITEM, "ItmsGrpCod"))


@rule("ITM-04", DUPLICATE, "Item codes used more than once", "OITM", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return duplicates(t["OITM"], {"ItemCode": F.col("ItemCode")}, "NbDoublons")


@rule("ITM-05", DUPLICATE, "Item names used more than once", "OITM", "ItemName")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return duplicates(t["OITM"], {"ItemName": F.col("ItemName")}, "NbDoublons")


row_rule(
    "ITM-06", MISSING, "Purchasable items without a supplier", "OITM",
    lambda as_of: (F.col("PrchseItem") == YES) & blank("CardCode"), ITEM,
)


def purchasable_items(t: TableMap) -> DataFrame:
    return t["OITM"].filter(F.col("PrchseItem") == YES).select(*ITEM)


def listed_suppliers(t: TableMap) -> DataFrame:
    return t["ITM2"].filter(~blank("CardCode"))


SUPPLIER_COUNT = "NbFournisseurs"


@rule("ITM-07", INCONSISTENT, "Purchasable items with a single listed supplier", "OITM ITM2", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    on = {"ItemCode": "ItemCode"}
    return at_most_one(purchasable_items(t), listed_suppliers(t), on, SUPPLIER_COUNT, "CardCode", none=False, hot=False)


@rule("ITM-07-none", INCONSISTENT, "Purchasable items with one listed supplier or none", "OITM ITM2", "ItemCode", variant=True)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return at_most_one(purchasable_items(t), listed_suppliers(t), {"ItemCode": "ItemCode"}, SUPPLIER_COUNT, "CardCode", hot=False)


row_rule("ITM-08", MISSING, "Items without a procurement method", "OITM", lambda as_of: blank("PrcrmntMtd"), (*ITEM, "PrcrmntMtd"))


row_rule(
    "ITM-09", MISSING, "Made items without a bill of materials, short form", MADE_WITHOUT_BOM,
    lambda as_of: F.lit(True), ITEM,
)


row_rule(
    "ITM-10", INCONSISTENT, "Bought items with a bill of materials", BOM_HEADERS,
    lambda as_of: F.col("PrcrmntMtd") == BOUGHT, (("ItemCode", "Code"), "ItemName"),
)

row_rule(
    "ITM-11", MISSING, "Warehouse stock without a minimum or maximum level", WAREHOUSE_STOCK,
    lambda as_of: is_missing("MinLevel", "MaxLevel", kind="zero"),
    (*ITEM, "WhsCode", "MinLevel", "MaxLevel"), key="ItemCode WhsCode",
)

row_rule(
    "ITM-12", INCONSISTENT, "Minimum level above the maximum", WAREHOUSE_STOCK,
    lambda as_of: F.col("MinLevel") > F.col("MaxLevel"),
    (*ITEM, "WhsCode", "MinLevel", "MaxLevel"), key="ItemCode WhsCode",
)

row_rule(
    "ITM-13", INVALID, "Inactive items", "OITM",
    lambda as_of: F.col("validFor") == NO, (*ITEM, ("ValidFor", "validFor"), "UpdateDate"),
)

row_rule(
    "ITM-14", INCONSISTENT, "Items not updated for two years", "OITM",
    lambda as_of: F.col("UpdateDate") < months_before(as_of, IDLE_ITEM_MONTHS),
    (*ITEM, "UpdateDate", ("JoursInactivite", lambda as_of: days_since("UpdateDate", as_of))),
)

row_rule(
    "ITM-15", MISSING, "Items without a default warehouse", "OITM",
    lambda as_of: blank("DfltWH"), (*ITEM, ("EntrepotDefaut", "DfltWH")),
)

row_rule(
    "ITM-16", MISSING, "Items with a missing or very short name", "OITM",
    lambda as_of: F.col("ItemName").isNull() | (F.length(F.trim("ItemName")) < SHORTEST_NAME),
    (*ITEM, ("LongueurNom", lambda as_of: F.length("ItemName").cast("bigint"))),
)

row_rule(
    "ITM-17", MISSING, "Items without a barcode", "OITM",
    lambda as_of: blank("CodeBars"),
    (*ITEM, ("CodeBarres", lambda as_of: F.coalesce("CodeBars", F.lit(NO_BARCODE)))),
)

row_rule(
    "ITM-18", MISSING, "Items without a weight or a dimension", "OITM",
    lambda as_of: is_missing("SWeight1", "SHeight1", "SWidth1", "SLength1", kind="zero"),
    (*ITEM, "SWeight1", "SHeight1", "SWidth1", "SLength1"),
)


row_rule(
    "ITM-19", INVALID, "Inactive parents of bills of materials", BOM_HEADERS,
    lambda as_of: F.col("validFor") == NO, (("CodeParent", "Code"), "ItemName", ("ValidFor", "validFor")),
)


@rule("ITM-20", INCONSISTENT, "Items without a stock movement for a year", "OITM OINM", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    idle = stale(
        t["OITM"].select(*ITEM), newest_movements(t).select("Place.ItemCode", "DocDate"), {"ItemCode": "ItemCode"}, "DocDate",
        months_before(as_of, IDLE_MOVEMENT_MONTHS), "DernierMouvement", hot=False,
    )
    return idle.distinct()


@rule("ITM-21", INCONSISTENT, "Items with differing levels between warehouses", "OITM OITW", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    levels = F.struct(or_zero("MinLevel"), or_zero("MaxLevel"))
    return cardinality(
        t["OITM"].select(*ITEM), t["OITW"], {"ItemCode": "ItemCode"},
        {"NbEntrepots": F.count_distinct("WhsCode"), "NbParamSets": F.count_distinct(levels)}, low=2, hot=False,
    )
