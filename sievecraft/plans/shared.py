"""What the checks share when many of them run at once.

On its own, a check looks up only what it needs, mostly as an anti join. Together, checks that look at the
same rows read them once: marks say what other tables know about a row's key, and each check is a
condition on rows and marks. Checks that count keys share one count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank, days_before, days_since, difference, empty, months_before, or_zero, rounded_product
from ..operators import Marks, attach, found, marked, splittable
from .bom import BOM_HEADERS, BOM_LINES, LINE, MADE_WITHOUT_BOM
from .constants import (
    BOUGHT, HAS_BOM, HAS_NO_BOM, IDLE_MOVEMENT_MONTHS, IDLE_STOCK_DAYS, MADE, NEVER_MOVED, NO, STOCK_COUNT, SUPPLIER, YES,
)
from .items import ITEM, SUPPLIER_COUNT, WAREHOUSE_STOCK, listed_suppliers
from .rule import WIDER, Source, TableMap, keyed, shared
from .sales import active_customer, on_sale
from .suppliers import ITEMS_WITH_SUPPLIER


def one_or_none(lowest: str, highest: str) -> Column:
    """Whether the values between these two are one at most."""
    return F.col(lowest).isNull() | (F.col(lowest) == F.col(highest))


def items_with_facts(t: TableMap) -> DataFrame:
    """Items with what headers, prices, order lines, supplier lists and movements say about them.

    Texts are compared in an aggregate of their own, which sorts; the others combine by hash.
    """
    items = marked(
        t["OITM"], {"ItemCode": "item"},
        Marks(t["OITT"], {"item": "Code"}, {"HasHeader": found()}),
        Marks(t["ITM1"], {"item": "ItemCode"}, {"HasPrice": found()}),
        Marks(t["OINM"], {"item": "ItemCode"}, {"LastMoved": (F.max, [F.col("DocDate")])}),
        hot=False,
    )
    return marked(
        items, {"ItemCode": "item"},
        Marks(t["POR1"], {"item": "ItemCode"}, {"FirstOrdered": (F.min, [F.col("CardCode")]), "LastOrdered": (F.max, [F.col("CardCode")])}),
        Marks(listed_suppliers(t), {"item": "ItemCode"}, {"FirstListed": (F.min, [F.col("CardCode")]), "LastListed": (F.max, [F.col("CardCode")])}),
        hot=False,
    )


ITEMS_WITH_FACTS = Source("items with facts", ("OITM", "OITT", "ITM1", "POR1", "ITM2", "OINM"), items_with_facts)
WIDER[MADE_WITHOUT_BOM.name] = (ITEMS_WITH_FACTS, lambda: (F.col("PrcrmntMtd") == MADE) & F.col("HasHeader").isNull())

shared("SAL-04", ITEMS_WITH_FACTS, lambda as_of: on_sale() & F.col("HasPrice").isNull(), (*ITEM, "ItmsGrpCod", "OnHand"))

shared(
    "SUP-02", ITEMS_WITH_FACTS,
    lambda as_of: (F.col("PrcrmntMtd") == BOUGHT) & ~empty("CardCode") & one_or_none("FirstOrdered", "LastOrdered"),
    (
        *ITEM, ("FournisseurPrincipal", "CardCode"),
        ("NbFournisseursDifferents", lambda as_of: F.when(F.col("FirstOrdered").isNull(), 0).otherwise(1).cast("bigint")),
    ),
    distinct=(),
)

shared(
    "ITM-07", ITEMS_WITH_FACTS,
    lambda as_of: (F.col("PrchseItem") == YES) & (F.col("FirstListed") == F.col("LastListed")),
    (*ITEM, (SUPPLIER_COUNT, lambda as_of: F.lit(1).cast("bigint"))), distinct=(),
)

shared(
    "ITM-20", ITEMS_WITH_FACTS,
    lambda as_of: F.col("LastMoved").isNull() | (F.col("LastMoved") < months_before(as_of, IDLE_MOVEMENT_MONTHS)),
    (*ITEM, ("DernierMouvement", "LastMoved")), distinct=(),
)


def codes(t: TableMap) -> DataFrame:
    """Every code of an item or a header: the item, as often as it is listed (``First`` says where first), and its number of headers."""
    headers = t["OITT"].filter(F.col("Code").isNotNull()).groupBy("Code").agg(F.count("*").alias("Headers"))
    items = t["OITM"].filter(F.col("ItemCode").isNotNull()).select("ItemCode", "ItemName", "validFor", "InvntryUom", "PrcrmntMtd")
    listed = Window.partitionBy("ItemCode").orderBy("ItemName")
    items = items.withColumn("First", F.row_number().over(listed) == 1)
    known = items.join(splittable(headers), F.col("ItemCode") == F.col("Code"), "full")
    return known.withColumn("Code", F.coalesce("Code", "ItemCode"))


def lines_with_codes(t: TableMap) -> DataFrame:
    """Lines with what is known about the code of their component and that of their parent."""
    lines = attach(
        t["ITT1"], codes(t), {"Code": "Code"}, grouped=True, ItemCode="ItemCode", ComponentName="ItemName", validFor="validFor",
        InvntryUom="InvntryUom", ComponentProcurement="PrcrmntMtd", Headers="Headers",
    )
    return attach(
        lines, codes(t), {"Father": "Code"}, grouped=True,
        ParentItem="ItemCode", ParentName="ItemName", ParentFirst="First", ParentHeaders="Headers",
    )


def both_items() -> Column:
    return F.col("ItemCode").isNotNull() & F.col("ParentItem").isNotNull()


LINES_WITH_CODES = Source("lines with codes", ("ITT1", "OITM", "OITT"), lines_with_codes)
WIDER[BOM_LINES.name] = (LINES_WITH_CODES, both_items)

shared(
    "BOM-10", LINES_WITH_CODES, lambda as_of: both_items() & (F.col("Father") == F.col("Code")), (*LINE, "Quantity"), distinct=()
)

shared(
    "BOM-13", LINES_WITH_CODES,
    # The parent's item is not asked for, so its copies must not repeat the line.
    lambda as_of: F.col("ItemCode").isNotNull() & F.col("ParentHeaders").isNull() & F.coalesce("ParentFirst", F.lit(True)),
    (("ParentInexistant", "Father"), ("Component", "Code"), "ComponentName", "Quantity"),
)

shared(
    "BOM-14", LINES_WITH_CODES, lambda as_of: F.col("ItemCode").isNull() & F.col("ParentItem").isNotNull(),
    (("Parent", "Father"), "ParentName", ("ComponentInexistant", "Code"), "Quantity"),
)

shared(
    "BOM-15", LINES_WITH_CODES, lambda as_of: both_items() & (F.col("ComponentProcurement") == MADE),
    (
        *LINE, "ComponentProcurement", "Quantity",
        ("A_SousBOM", lambda as_of: F.when(F.col("Headers").isNotNull(), HAS_BOM).otherwise(HAS_NO_BOM)),
    ),
    times=lambda as_of: F.coalesce("Headers", F.lit(1)),
)


def headers_with_lines(t: TableMap) -> DataFrame:
    headers = marked(t["OITT"], {"Code": "parent"}, Marks(t["ITT1"], {"parent": "Father"}, {"HasLines": found()}))
    return attach(
        headers, t["OITM"], {"Code": "ItemCode"}, "inner", ItemName="ItemName", validFor="validFor", PrcrmntMtd="PrcrmntMtd"
    )


HEADERS_WITH_LINES = Source("headers with lines", ("OITT", "ITT1", "OITM"), headers_with_lines)
WIDER[BOM_HEADERS.name] = (HEADERS_WITH_LINES, lambda: F.lit(True))

shared(
    "BOM-02", HEADERS_WITH_LINES, lambda as_of: F.col("HasLines").isNull(), (("Parent", "Code"), ("ParentName", "ItemName"), "TreeType")
)


def items_with_partner(t: TableMap) -> DataFrame:
    return attach(
        t["OITM"], t["OCRD"], {"CardCode": "CardCode"},
        CardName="CardName", Partner="CardCode", PartnerType="CardType", PartnerValidFor="validFor",
    )


ITEMS_WITH_PARTNER = Source("items with partner", ("OITM", "OCRD"), items_with_partner)
WIDER[ITEMS_WITH_SUPPLIER.name] = (ITEMS_WITH_PARTNER, lambda: F.lit(True))

shared(
    "SUP-03", ITEMS_WITH_PARTNER,
    lambda as_of: (F.col("PrcrmntMtd") == BOUGHT) & (F.col("PartnerType") == SUPPLIER) & (F.col("PartnerValidFor") == NO),
    (*ITEM, "CardCode", "CardName", ("validFor", "PartnerValidFor")),
)

shared(
    "SUP-13", ITEMS_WITH_PARTNER,
    lambda as_of: (F.col("PrcrmntMtd") == BOUGHT) & ~empty("CardCode") & F.col("Partner").isNull(),
    (*ITEM, ("FournisseurInexistant", "CardCode")),
)


def partners_with_contacts(t: TableMap) -> DataFrame:
    """Suppliers and active customers with their contacts, and whether their currency is known."""
    shown = ("CardCode", "CardName", "E_Mail", "Phone1")
    partners = t["OCRD"].select(*shown, "CardType", "validFor", "Currency").filter((F.col("CardType") == SUPPLIER) | active_customer())
    rows = marked(
        partners, {"CardCode": "partner"},
        Marks(t["OCPR"], {"partner": "CardCode"}, {"HasContact": found(), "Contacts": (F.count, [F.col("CntctCode")])}),
        hot=False,
    )
    # Equal rows each count the contacts. The window needs no shuffle beyond the one by code.
    rows = rows.withColumn("Copies", F.count("*").over(Window.partitionBy(*shown, "CardType", "validFor")))
    return marked(rows, {"Currency": "currency"}, Marks(t["OCRN"], {"currency": "CurrCode"}, {"KnownCurrency": found()}))


PARTNERS_WITH_CONTACTS = Source("partners with contacts", ("OCRD", "OCPR", "OCRN"), partners_with_contacts)

shared(
    "SUP-11", PARTNERS_WITH_CONTACTS, lambda as_of: (F.col("CardType") == SUPPLIER) & F.col("HasContact").isNull(),
    ("CardCode", "CardName", "Phone1", "E_Mail"),
)

shared(
    "SUP-12", PARTNERS_WITH_CONTACTS,
    lambda as_of: (F.col("CardType") == SUPPLIER) & ~empty("Currency") & F.col("KnownCurrency").isNull(),
    ("CardCode", "CardName", ("DeviseInvalide", "Currency")),
)

shared(
    "SAL-A5", PARTNERS_WITH_CONTACTS, lambda as_of: active_customer() & (F.col("Contacts") * F.col("Copies") > 1),
    ("CardCode", "CardName", ("NombreContacts", lambda as_of: F.col("Contacts") * F.col("Copies")), "E_Mail", "Phone1"), distinct=(),
)


def places(t: TableMap) -> DataFrame:
    """Stock of items by warehouse with its newest movement, its newest count, and whether all its bins have a code."""
    counted = F.col("TransType") == STOCK_COUNT
    # Newest day first, the larger quantity within a day; a NULL comes last. The order is a number, which combines by hash.
    # The quantity is what it leaves beside whole days; read there only, it is worked out for counts alone.
    none = F.lit(-2 * 10**13).cast("decimal(21,6)")
    a_day, half = F.lit(10**15).cast("decimal(16,0)"), F.lit(5 * 10**14).cast("decimal(16,0)")
    day = F.coalesce(F.unix_date("DocDate").cast("decimal(8,0)"), F.lit(-9_999_999).cast("decimal(8,0)"))
    order = F.when(counted, day * a_day + F.coalesce(F.col("InQty").cast("decimal(21,6)"), none))
    size = (F.pmod(F.col("LastCount") + half, a_day) - half).cast("decimal(21,6)")
    quantity = F.when(size != none, size).cast(t["OINM"].schema["InQty"].dataType)
    bins = t["OBIN"].groupBy("AbsEntry").agg(F.bool_and(~blank("BinCode")).alias("Coded"))
    stored = attach(t["OIBQ"], bins, {"BinAbs": "AbsEntry"}, grouped=True, Coded="Coded")
    on = {"item": "ItemCode", "warehouse": "Warehouse"}
    stock = marked(
        t["OITW"], {"ItemCode": "item", "WhsCode": "warehouse"},
        Marks(t["OINM"], on, {"Moved": (F.max, [F.col("DocDate")]), "LastCount": (F.max, [order])}),
        Marks(stored, {**on, "warehouse": "WhsCode"}, {"Located": (F.bool_and, [F.coalesce("Coded", F.lit(False))])}),
        hot=False,
    ).withColumn("Counted", quantity)
    return attach(stock, t["OITM"], {"ItemCode": "ItemCode"}, "inner", ItemName="ItemName", validFor="validFor", AvgPrice="AvgPrice")


PLACES = Source("places", ("OITW", "OITM", "OINM", "OIBQ", "OBIN"), places)
WIDER[WAREHOUSE_STOCK.name] = (PLACES, lambda: F.lit(True))


def active_stock() -> Column:
    return (F.col("OnHand") > 0) & (F.col("validFor") == YES)


shared(
    "STK-01", PLACES, lambda as_of: F.col("OnHand") != or_zero("Counted"),
    (
        *ITEM, "WhsCode", "OnHand", ("DernierInventaire", lambda as_of: or_zero("Counted")),
        ("Ecart", lambda as_of: difference("OnHand", or_zero("Counted"))),
    ),
)

shared(
    "STK-03", PLACES, lambda as_of: active_stock() & ~F.coalesce("Located", F.lit(False)),
    (*ITEM, "WhsCode", "OnHand"), distinct=(),
)


def last_moved() -> Column:
    return F.coalesce("Moved", F.lit(NEVER_MOVED))


shared(
    "STK-06", PLACES,
    lambda as_of: active_stock() & (F.col("Moved").isNull() | (F.col("Moved") < days_before(as_of, IDLE_STOCK_DAYS))),
    (
        *ITEM, "WhsCode", "OnHand", ("DernierMvt", lambda as_of: last_moved()),
        ("JoursSansMouvement", lambda as_of: days_since(last_moved(), as_of)),
        ("ValeurStock", lambda as_of: rounded_product("OnHand", "AvgPrice")),
    ),
    distinct=("AvgPrice",),
)


def is_supplier() -> Column:
    return F.col("CardType") == SUPPLIER


keyed("ITM-04", "OITM", {"ItemCode": lambda: F.col("ItemCode")}, "NbDoublons")
keyed("ITM-05", "OITM", {"ItemName": lambda: F.col("ItemName")}, "NbDoublons")
keyed("SUP-07", "OCRD", {"CardCode": lambda: F.col("CardCode")}, "NombreOccurrences", where=is_supplier)
keyed("SUP-08b", "OCRD", {"NomNormalise": lambda: F.upper("CardName")}, "NombreOccurrences", where=is_supplier)
keyed(
    "SAL-07", "OITM", {name: lambda name=name: F.col(name) for name in ("ItemCode", "ItemName", "validFor", "SellItem", "OnHand")},
    where=lambda: (F.col("validFor") == NO) & (F.col("SellItem") == YES), least=1,
)
