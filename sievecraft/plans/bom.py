"""Checks of bills of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, blank, not_positive
from ..operators import attach, copies, cycle_members, deeper_than, duplicates, orphans, rare_orphans, self_loops
from .constants import DEEPEST_BOM, HAS_BOM, HAS_NO_BOM, MADE, NO
from .rule import COMPLEXITY, DUPLICATE, INCONSISTENT, INTEGRITY, INVALID, MISSING, Source, TableMap, row_rule, rule


def with_parent(rows: DataFrame, items: DataFrame, code: str = "Father", grouped: bool = False) -> DataFrame:
    """Rows whose parent is an item, with the parent's name. ``grouped`` states that the rows are laid out by the parent."""
    return attach(rows, items, {code: "ItemCode"}, "inner", grouped=grouped, ParentName="ItemName")


def with_component(lines: DataFrame, items: DataFrame, **more: str) -> DataFrame:
    """Lines whose component is an item, with the component's name."""
    return attach(lines, items, {"Code": "ItemCode"}, "inner", ComponentName="ItemName", **more)


def made_without_bom(t: TableMap) -> DataFrame:
    return orphans(t["OITM"].filter(F.col("PrcrmntMtd") == MADE), t["OITT"], {"ItemCode": "Code"}, hot=False)


def bom_lines(t: TableMap) -> DataFrame:
    lines = with_component(t["ITT1"], t["OITM"], ItemCode="ItemCode", validFor="validFor", InvntryUom="InvntryUom")
    return with_parent(lines, t["OITM"])


def bom_headers(t: TableMap) -> DataFrame:
    return attach(
        t["OITT"], t["OITM"], {"Code": "ItemCode"}, "inner",
        ItemName="ItemName", validFor="validFor", PrcrmntMtd="PrcrmntMtd",
    )


# Lines with the item of their component and the name of their parent.
BOM_LINES = Source("bill-of-material lines", ("ITT1", "OITM"), bom_lines)
# Items that are made, but have no header.
MADE_WITHOUT_BOM = Source("made items without a bill of materials", ("OITM", "OITT"), made_without_bom)
# Headers with the item they describe.
BOM_HEADERS = Source("bill-of-material headers", ("OITT", "OITM"), bom_headers)
LINE = (("Parent", "Father"), "ParentName", ("Component", "Code"), "ComponentName")
HEADER = (("Parent", "Code"), ("ParentName", "ItemName"))


row_rule(
    "BOM-01", MISSING, "Made items without a bill of materials", MADE_WITHOUT_BOM,
    lambda as_of: F.lit(True), ("ItemCode", "ItemName", "PrcrmntMtd"),
)


@rule("BOM-02", MISSING, "Bills of materials without components", "OITT ITT1 OITM", "Parent")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    bare = orphans(t["OITT"], t["ITT1"], {"Code": "Father"})
    return with_parent(bare, t["OITM"], "Code", grouped=True).select(F.col("Code").alias("Parent"), "ParentName", "TreeType")


row_rule(
    "BOM-03", INVALID, "Components that are inactive items", BOM_LINES,
    lambda as_of: F.col("validFor") == NO, (*LINE, "validFor", "Quantity"), key="Parent Component",
)

row_rule(
    "BOM-04", INCONSISTENT, "Component quantities missing, zero or negative", BOM_LINES,
    lambda as_of: not_positive("Quantity"), (*LINE, "Quantity"), key="Parent Component",
)

row_rule(
    "BOM-05", MISSING, "Bills of materials without a type", BOM_HEADERS,
    lambda as_of: blank("TreeType"), ("Code", ("Name", "ItemName"), "TreeType"),
)

row_rule(
    "BOM-06", MISSING, "Bills of materials without a production warehouse", BOM_HEADERS,
    lambda as_of: blank("ToWH"), ("Code", ("Name", "ItemName"), ("EntrepotProduction", "ToWH")),
)

row_rule(
    "BOM-07", INVALID, "Bills of materials of inactive items", BOM_HEADERS,
    lambda as_of: F.col("validFor") == NO, (*HEADER, "validFor", "TreeType"),
)


@rule("BOM-08", DUPLICATE, "Several bills of materials for one item", "OITT", "Parent")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return duplicates(t["OITT"], {"Parent": F.col("Code")}, "NbVersions", {"Versions": "Name"}).select(
        "Parent", "NbVersions", "Versions"
    )


@rule("BOM-09", DUPLICATE, "Components listed more than once", "ITT1 OITM", "Parent Component")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    # A repeated item code counts its lines once per copy. Both sides are reduced
    # first and the copies multiplied in, which spares joining the single lines.
    lines = t["ITT1"].groupBy("Father", "Code").agg(F.count("*").alias("lines"), F.sum("Quantity").alias("quantity"))
    items = copies(t["OITM"], "ItemCode", "ItemName")
    named = attach(lines, items, {"Code": "ItemCode"}, "inner", ComponentName="ItemName", c_copies="copies")
    named = attach(named, items, {"Father": "ItemCode"}, "inner", ParentName="ItemName", p_copies="copies")
    factor = F.col("c_copies") * F.col("p_copies")
    return named.select(
        F.col("Father").alias("Parent"), "ParentName", F.col("Code").alias("Component"), "ComponentName",
        (F.col("lines") * factor).alias("NbOccurrences"),
        (F.col("quantity") * factor).cast("decimal(38,6)").alias("QuantiteTotale"),
    ).filter(F.col("NbOccurrences") > 1)


@rule("BOM-10", INCONSISTENT, "Items that are their own component", "ITT1 OITM", "Parent")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    loops = self_loops(t["ITT1"], "Father", "Code").select("Father", "Code", "Quantity").distinct()
    codes = loops.select(F.col("Code").alias("ItemCode")).distinct()
    names = attach(codes, t["OITM"], {"ItemCode": "ItemCode"}, "inner", ItemName="ItemName").distinct()
    return with_parent(with_component(loops, names), names).select(
        F.col("Father").alias("Parent"), "ParentName", F.col("Code").alias("Component"), "ComponentName", "Quantity"
    )


# The source joins lines to items on the very codes compared here, so nothing is
# found whatever the data. Titled as a unit mismatch, but lines carry no unit.
row_rule(
    "BOM-11", INCONSISTENT, "Component code differs from the code of its item", BOM_LINES,
    lambda as_of: F.col("Code") != F.col("ItemCode"),
    (*LINE, "Quantity", ("UoM_Article", "InvntryUom"), ("Methode_Sortie", "IssueMthd")),
    key="Parent Component", order={"Parent": "asc", "Component": "asc"},
)

row_rule(
    "BOM-12", MISSING, "Bills of materials without a base quantity", BOM_HEADERS,
    lambda as_of: not_positive("Qauntity"), (*HEADER, "TreeType", ("QuantiteBase", "Qauntity")),
)


@rule("BOM-13", INTEGRITY, "Lines of bills of materials that do not exist", "ITT1 OITM OITT", "ParentInexistant Component")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return with_component(rare_orphans(t["ITT1"], t["OITT"], {"Father": "Code"}), t["OITM"]).select(
        F.col("Father").alias("ParentInexistant"), F.col("Code").alias("Component"), "ComponentName", "Quantity"
    )


@rule("BOM-14", INTEGRITY, "Components that are not items", "ITT1 OITM", "Parent ComponentInexistant")
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return with_parent(rare_orphans(t["ITT1"], t["OITM"], {"Code": "ItemCode"}), t["OITM"]).select(
        F.col("Father").alias("Parent"), "ParentName", F.col("Code").alias("ComponentInexistant"), "Quantity"
    )


@rule(
    "BOM-15", COMPLEXITY, "Components that are themselves made", "ITT1 OITM OITT", "Parent Component",
    {"Parent": "asc", "Component": "asc"},
)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    # Headers join the made items, not the lines, so the lines meet both in one join.
    made = attach(
        t["OITM"].filter(F.col("PrcrmntMtd") == MADE), t["OITT"], {"ItemCode": "Code"}, "left", Header="Code"
    ).withColumn("A_SousBOM", F.when(F.col("Header").isNotNull(), HAS_BOM).otherwise(HAS_NO_BOM))
    lines = with_component(t["ITT1"], made, grouped=True, ComponentProcurement="PrcrmntMtd", A_SousBOM="A_SousBOM")
    return with_parent(lines, t["OITM"]).select(
        F.col("Father").alias("Parent"), "ParentName", F.col("Code").alias("Component"), "ComponentName",
        "ComponentProcurement", "Quantity", "A_SousBOM",
    )


@rule("BOM-10-cycle", INCONSISTENT, "Items that contain themselves at any level", "ITT1 OITM", "Parent", variant=True)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    return with_parent(cycle_members(t["ITT1"], "Father", "Code"), t["OITM"], "node").select(
        F.col("node").alias("Parent"), "ParentName"
    )


@rule("BOM-15-depth", COMPLEXITY, "Bills of materials of more than five levels", "ITT1 OITM", "Parent", variant=True)
def _(t: TableMap, as_of: AsOf) -> DataFrame:
    deep = deeper_than(t["ITT1"], "Father", "Code", DEEPEST_BOM)
    return with_parent(deep, t["OITM"], "node", grouped=True).select(F.col("node").alias("Parent"), "ParentName")
