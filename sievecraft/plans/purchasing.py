"""Checks of purchasing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, blank, difference, is_missing, unset, zero
from .constants import MADE, PRICE_RISE, PURCHASED, SUPPLIER, YES
from .rule import INCONSISTENT, MISSING, TableMap, row_rule, rule
from .suppliers import ITEMS_WITH_SUPPLIER, unpriced


def purchased() -> Column:
    """The item is active and purchased."""
    return (F.col("PrcrmntMtd") == PURCHASED) & (F.col("validFor") == YES)


def active_supplier() -> Column:
    return (F.col("CardType") == SUPPLIER) & (F.col("validFor") == YES)


# Titled as missing purchase price, but the rule tests no price.
row_rule(
    "PUR-01", MISSING, "Purchased items with their default supplier", ITEMS_WITH_SUPPLIER,
    lambda as_of: purchased() & F.col("CardCode").isNotNull(),
    ("ItemCode", "ItemName", ("FournisseurPrincipal", "CardCode"), "CardName"),
)

row_rule(
    "PUR-02", INCONSISTENT, "Last purchase price over 120% of the average", "OITM",
    lambda as_of: purchased()
    & (F.col("AvgPrice") > 0)
    & (F.col("LastPurPrc") > F.col("AvgPrice") * F.lit(PRICE_RISE)),
    ("ItemCode", "ItemName", ("PrixMoyenActuel", "AvgPrice"), ("DernierPrixAchat", "LastPurPrc")),
)

row_rule(
    "PUR-03", MISSING, "Active suppliers without payment terms", "OCRD",
    lambda as_of: active_supplier() & unset("GroupNum", -1),
    ("CardCode", "CardName", "GroupCode", "GroupNum"),
)

row_rule(
    "PUR-04", MISSING, "Purchased or made items without a tax code", "OITM",
    lambda as_of: F.col("PrcrmntMtd").isin(PURCHASED, MADE) & (F.col("validFor") == YES) & blank("TaxCodeAP"),
    ("ItemCode", "ItemName", ("TaxCode", "TaxCodeAP"), "PrcrmntMtd"),
)


row_rule(
    "PUR-05", MISSING, "Purchased items without a lead time", ITEMS_WITH_SUPPLIER,
    lambda as_of: purchased() & zero("LeadTime"),
    ("ItemCode", "ItemName", ("DelaisArticle", "LeadTime"), ("FournisseurPrincipal", "CardCode"), "CardName"),
)

row_rule(
    "PUR-06", MISSING, "Active suppliers without a currency", "OCRD",
    lambda as_of: active_supplier() & blank("Currency"),
    ("CardCode", "CardName", "Currency", "GroupCode"),
)

row_rule(
    "PUR-07", MISSING, "Purchased items without a default supplier", "OITM",
    lambda as_of: purchased() & blank("CardCode"),
    ("ItemCode", "ItemName", ("FournisseurPrincipal", "CardCode"), "PrcrmntMtd"),
)


row_rule(
    "PUR-08", INCONSISTENT, "Purchased items committed beyond their stock", ITEMS_WITH_SUPPLIER,
    lambda as_of: purchased() & (difference("OnHand", "IsCommited") < 0),
    (
        "ItemCode", "ItemName", ("StockPhysique", "OnHand"), ("Engage", "IsCommited"),
        ("StockDisponible", lambda as_of: difference("OnHand", "IsCommited")),
        ("FournisseurPrincipal", "CardCode"), "CardName",
    ),
)

row_rule(
    "PUR-09", MISSING, "Active suppliers with an incomplete address", "OCRD",
    lambda as_of: active_supplier() & is_missing("Country", "City"),
    ("CardCode", "CardName", "Address", "City", "Country"),
)

row_rule(
    "PUR-10", INCONSISTENT, "Purchased items without an average price", "OITM",
    lambda as_of: purchased() & zero("AvgPrice"),
    ("ItemCode", "ItemName", "AvgPrice", ("DernierPrixAchat", "LastPurPrc"), ("FournisseurPrincipal", "CardCode")),
)


@rule("PUR-01-price", MISSING, "Purchased items without any price", "OITM ITM1", "ItemCode", variant=True)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    items = t["OITM"].filter(purchased() & F.col("CardCode").isNotNull())
    return unpriced(items, t).select("ItemCode", "ItemName", F.col("CardCode").alias("FournisseurPrincipal"))
