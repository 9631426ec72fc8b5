"""Checks of customers, prices and sellable items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, blank, days_since, difference, percentage, today, unset, zero
from ..operators import attach, cardinality, orphans
from .constants import CUSTOMER, DEFAULT_PRICE_LIST, EXPIRED, NO, NO_END, NO_START, OTHER_PROBLEM, YES
from .rule import INCONSISTENT, MISSING, Source, TableMap, row_rule, rule


def active_customer() -> Column:
    return (F.col("CardType") == CUSTOMER) & (F.col("validFor") == YES)


def on_sale() -> Column:
    """The item is active and sellable."""
    return (F.col("SellItem") == YES) & (F.col("validFor") == YES)


def priced_items(t: TableMap) -> DataFrame:
    """Items on sale with their prices in the default list."""
    prices = t["ITM1"].filter(F.col("PriceList") == DEFAULT_PRICE_LIST)
    items = t["OITM"].filter(on_sale()).select("ItemCode", "ItemName", "LastPurPrc")
    return attach(
        items, prices, {"ItemCode": "ItemCode"}, "inner", PriceList="PriceList", Price="Price", Currency="Currency"
    )


PRICED_ITEMS = Source("priced items", ("OITM", "ITM1"), priced_items)


def price_list_problem(as_of: AsOf) -> Column:
    """The first problem that applies; the last text cannot occur on a listed row."""
    return (
        F.when(F.col("ValidFrom").isNull(), NO_START)
        .when(F.col("ValidTo").isNull(), NO_END)
        .when(F.col("ValidTo") < today(as_of), EXPIRED)
        .otherwise(OTHER_PROBLEM)
    )


row_rule(
    "SAL-01", MISSING, "Active customers without an address", "OCRD",
    lambda as_of: active_customer() & blank("Address"),
    ("CardCode", "CardName", "Address", "Phone1", "E_Mail"), order={"CardCode": "asc"},
)

row_rule(
    "SAL-02", MISSING, "Active customers without a tax number", "OCRD",
    lambda as_of: active_customer() & blank("LicTradNum"),
    ("CardCode", "CardName", "LicTradNum", "Address", "Country"), order={"CardCode": "asc"},
)

row_rule(
    "SAL-03", INCONSISTENT, "Price lists expired or without a validity date", "OPLN",
    lambda as_of: F.col("ValidFrom").isNull() | F.col("ValidTo").isNull() | (F.col("ValidTo") < today(as_of)),
    (
        "ListNum", "ListName", "ValidFrom", "ValidTo", ("TypeProbleme", price_list_problem),
        ("JoursDepuisExpiration", lambda as_of: days_since("ValidTo", as_of)),
    ),
    order={"ValidTo": "desc"},
)


@rule("SAL-04", MISSING, "Items on sale without any price", "OITM ITM1", "ItemCode", {"ItemCode": "asc"})
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return orphans(t["OITM"].filter(on_sale()), t["ITM1"], {"ItemCode": "ItemCode"}, hot=False).select(
        "ItemCode", "ItemName", "ItmsGrpCod", "OnHand"
    )


row_rule(
    "SAL-05", MISSING, "Active customers without payment terms", "OCRD",
    lambda as_of: active_customer() & unset("GroupNum", -1, 0),
    ("CardCode", "CardName", "GroupCode", ("ConditionsPaiement", "GroupNum"), "Balance"), order={"CardCode": "asc"},
)

row_rule(
    "SAL-06", MISSING, "Active customers without a shipping type", "OCRD",
    lambda as_of: active_customer() & unset("ShipType", -1, 0),
    ("CardCode", "CardName", "ShipType", "Address", "City"), order={"CardCode": "asc"},
)


@rule("SAL-07", INCONSISTENT, "Inactive items still sellable", "OITM", "ItemCode", {"ItemCode": "asc"})
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    inactive = t["OITM"].filter((F.col("validFor") == NO) & (F.col("SellItem") == YES))
    return inactive.select("ItemCode", "ItemName", "validFor", "SellItem", "OnHand").distinct()


row_rule(
    "SAL-08", INCONSISTENT, "Sales unit differs from the inventory unit", "OITM",
    # A NULL on either side makes the comparison NULL, so the row is not listed.
    lambda as_of: on_sale() & (F.col("InvntryUom") != F.col("SalUnitMsr")),
    (
        "ItemCode", "ItemName", ("UniteStock", "InvntryUom"), ("UniteVente", "SalUnitMsr"),
        ("UniteAchat", "BuyUnitMsr"),
    ),
    order={"ItemCode": "asc"},
)

row_rule(
    "SAL-A1", INCONSISTENT, "Active customers over their credit limit", "OCRD",
    lambda as_of: active_customer() & (F.col("CreditLine") > 0) & (F.col("Balance") > F.col("CreditLine")),
    (
        "CardCode", "CardName", ("LimiteCredit", "CreditLine"), ("SoldeActuel", "Balance"),
        ("Depassement", lambda as_of: difference("Balance", "CreditLine")),
        ("PourcentageUtilisation", lambda as_of: percentage("Balance", "CreditLine")),
        ("TelMobile", "Cellular"),
    ),
    order={"Depassement": "desc"},
)


row_rule(
    "SAL-A2", MISSING, "Items on sale without a price in the default list", PRICED_ITEMS,
    lambda as_of: zero("Price"), ("ItemCode", "ItemName", ("ListNum", "PriceList"), "Price", "Currency"),
    order={"ItemCode": "asc"},
)

row_rule(
    "SAL-A3", MISSING, "Active customers without a group", "OCRD",
    lambda as_of: active_customer() & unset("GroupCode", -1, 0),
    ("CardCode", "CardName", "GroupCode", "Balance", "CreateDate"), order={"CreateDate": "desc"},
)

row_rule(
    "SAL-A4", MISSING, "Active items without a group", "OITM",
    lambda as_of: (F.col("validFor") == YES) & unset("ItmsGrpCod", -1, 0),
    ("ItemCode", "ItemName", "ItmsGrpCod", "OnHand", "SellItem"), order={"ItemCode": "asc"},
)


@rule("SAL-A5", INCONSISTENT, "Active customers with several contacts", "OCRD OCPR", "CardCode", {"NombreContacts": "desc"})
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    customers = t["OCRD"].filter(active_customer()).select("CardCode", "CardName", "E_Mail", "Phone1")
    return cardinality(
        customers, t["OCPR"], {"CardCode": "CardCode"}, {"NombreContacts": F.count("CntctCode")},
        low=2, per_copy=True,
    ).select("CardCode", "CardName", "NombreContacts", "E_Mail", "Phone1")


row_rule(
    "SAL-A6", INCONSISTENT, "Items sold below their last purchase price", PRICED_ITEMS,
    lambda as_of: (F.col("LastPurPrc") > 0) & (F.col("Price") < F.col("LastPurPrc")),
    (
        "ItemCode", "ItemName", ("DernierPrixAchat", "LastPurPrc"), ("PrixVente", "Price"),
        ("NumListe", "PriceList"), ("Marge", lambda as_of: difference("Price", "LastPurPrc")),
        ("PourcentageMarge", lambda as_of: percentage(difference("Price", "LastPurPrc"), "LastPurPrc")),
    ),
    order={"Marge": "asc"},
)
