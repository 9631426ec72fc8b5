"""Checks of suppliers and of the items' default supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, empty, is_missing, unset, zero
from ..operators import at_most_one, attach, duplicates, orphans, status_conflict
from .constants import BOUGHT, NO, SUPPLIER
from .rule import DUPLICATE, INTEGRITY, INVALID, MISSING, Source, TableMap, row_rule, rule


def bought_items(t: TableMap) -> DataFrame:
    return t["OITM"].filter(F.col("PrcrmntMtd") == BOUGHT)


def sourced_items(t: TableMap) -> DataFrame:
    """Bought items with a default supplier."""
    return bought_items(t).filter(~empty("CardCode"))


def suppliers(t: TableMap) -> DataFrame:
    return t["OCRD"].filter(F.col("CardType") == SUPPLIER)


def unpriced(items: DataFrame, t: TableMap) -> DataFrame:
    """Items without a positive price in any list."""
    return orphans(items, t["ITM1"].filter(F.col("Price") > 0), {"ItemCode": "ItemCode"}, hot=False)


def items_with_supplier(t: TableMap) -> DataFrame:
    return attach(t["OITM"], t["OCRD"], {"CardCode": "CardCode"}, CardName="CardName")


# Items with the name of their default supplier, if known.
ITEMS_WITH_SUPPLIER = Source("items with supplier", ("OITM", "OCRD"), items_with_supplier)


row_rule(
    "SUP-01", MISSING, "Bought items without a default supplier", "OITM",
    lambda as_of: (F.col("PrcrmntMtd") == BOUGHT) & empty("CardCode"),
    ("ItemCode", "ItemName", "PrcrmntMtd", ("FournisseurParDefaut", "CardCode")),
)


@rule("SUP-02", MISSING, "Bought items ordered from at most one supplier", "OITM POR1", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    items = sourced_items(t).select("ItemCode", "ItemName", F.col("CardCode").alias("FournisseurPrincipal"))
    return at_most_one(items, t["POR1"], {"ItemCode": "ItemCode"}, "NbFournisseursDifferents", "CardCode", hot=False)


@rule("SUP-03", INVALID, "Bought items whose default supplier is inactive", "OITM OCRD", "ItemCode CardCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return status_conflict(
        bought_items(t), suppliers(t), {"CardCode": "CardCode"}, F.col("validFor") == NO,
        CardName="CardName", SupplierValidFor="validFor",
    ).select("ItemCode", "ItemName", "CardCode", "CardName", F.col("SupplierValidFor").alias("validFor"))


row_rule(
    "SUP-04", MISSING, "Suppliers without any address", "OCRD",
    lambda as_of: (F.col("CardType") == SUPPLIER)
    & is_missing("Address", "MailAddres", kind="empty", need="all"),
    ("CardCode", "CardName", "Address", "MailAddres"),
)


# Titled as missing purchase price, but the rule tests no price.
row_rule(
    "SUP-05", MISSING, "Bought items with their default supplier and purchase unit", ITEMS_WITH_SUPPLIER,
    lambda as_of: (F.col("PrcrmntMtd") == BOUGHT) & ~empty("CardCode"),
    ("ItemCode", "ItemName", ("Fournisseur", "CardCode"), "CardName", "BuyUnitMsr", "NumInBuy"),
)

row_rule(
    "SUP-06", MISSING, "Bought items without a lead time", ITEMS_WITH_SUPPLIER,
    lambda as_of: (F.col("PrcrmntMtd") == BOUGHT) & zero("LeadTime"),
    ("ItemCode", "ItemName", ("Fournisseur", "CardCode"), "CardName", "LeadTime", "OrdrIntrvl", "MinOrdrQty"),
)


@rule("SUP-07", DUPLICATE, "Supplier codes used more than once", "OCRD", "CardCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return duplicates(suppliers(t), {"CardCode": F.col("CardCode")}, "NombreOccurrences")


@rule("SUP-08", DUPLICATE, "Suppliers with the same name, and their codes", "OCRD", "NomNormalise")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return duplicates(
        suppliers(t), {"NomNormalise": F.upper("CardName")}, "NombreOccurrences", {"Codes": "CardCode"}
    ).select("NomNormalise", "Codes", "NombreOccurrences")


@rule("SUP-08b", DUPLICATE, "Suppliers with the same name", "OCRD", "NomNormalise")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return duplicates(suppliers(t), {"NomNormalise": F.upper("CardName")}, "NombreOccurrences")


row_rule(
    "SUP-09", MISSING, "Suppliers without payment terms", "OCRD",
    lambda as_of: (F.col("CardType") == SUPPLIER) & unset("GroupNum", -1),
    ("CardCode", "CardName", "GroupNum"),
)

row_rule(
    "SUP-10", MISSING, "Suppliers without a currency", "OCRD",
    lambda as_of: (F.col("CardType") == SUPPLIER) & empty("Currency"),
    ("CardCode", "CardName", "Currency"),
)


@rule("SUP-11", MISSING, "Suppliers without a contact person", "OCRD OCPR", "CardCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return orphans(suppliers(t), t["OCPR"], {"CardCode": "CardCode"}, hot=False).select(
        "CardCode", "CardName", "Phone1", "E_Mail"
    )


@rule("SUP-12", INTEGRITY, "Suppliers with an unknown currency", "OCRD OCRN", "CardCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return orphans(suppliers(t).filter(~empty("Currency")), t["OCRN"], {"Currency": "CurrCode"}).select(
        "CardCode", "CardName", F.col("Currency").alias("DeviseInvalide")
    )


@rule("SUP-13", INTEGRITY, "Bought items whose default supplier does not exist", "OITM OCRD", "ItemCode")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return orphans(sourced_items(t), t["OCRD"], {"CardCode": "CardCode"}).select(
        "ItemCode", "ItemName", F.col("CardCode").alias("FournisseurInexistant")
    )


@rule("SUP-05-price", MISSING, "Sourced bought items without any price", "OITM ITM1", "ItemCode", variant=True)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return unpriced(sourced_items(t), t).select("ItemCode", "ItemName", F.col("CardCode").alias("Fournisseur"))
