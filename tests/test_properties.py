"""What adding clean rows and repairing rows does to the checks."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import sievecraft
from sievecraft.sources import SCHEMAS

AS_OF = datetime.date(2001, 8, 1)
DAY = datetime.date(2001, 7, 1)

# One clean record per table: an active purchased item, its supplier, and so on.
CLEAN = {
    "OITM": dict(
        ItemCode="clean", ItemName="clean item", PrcrmntMtd="P", CardCode="SC", validFor="Y", SellItem="Y",
        PrchseItem="Y", InvntryUom="EA", SalUnitMsr="EA", BuyUnitMsr="EA", NumInBuy=1, UgpEntry=90, IUoMEntry=1,
        ItmsGrpCod=100, TaxCodeAP="V20", LeadTime=3, OrdrIntrvl=1, MinOrdrQty=1, DfltWH="W1", CodeBars="40", SWeight1=1,
        SHeight1=1, SWidth1=1, SLength1=1, AvgPrice=10, LastPurPrc=12, OnHand=5, IsCommited=5, UpdateDate=DAY,
    ),
    "OCRD": dict(
        CardCode="SC", CardName="clean supplier", CardType="S", validFor="Y", GroupCode=100, GroupNum=1, ShipType=1,
        Currency="R0", Address="1 Street", MailAddres="Box 1", City="City", Country="FR", LicTradNum="TX1", Phone1="1",
        Cellular="1", E_Mail="a@example.com", Balance=0, CreditLine=100, CreateDate=DAY,
    ),
    "OCPR": dict(CardCode="SC", CntctCode=1),
    "OCRN": dict(CurrCode="R0"),
    "OITB": dict(ItmsGrpCod=100),
    "UGP1": dict(UgpEntry=90, UomEntry=2),
    "OPLN": dict(ListNum=1, ListName="list", ValidFrom=DAY, ValidTo=AS_OF),
    "ITM1": dict(ItemCode="clean", PriceList=1, Price=12, Currency="R0"),
    "POR1": dict(ItemCode="clean", CardCode="SC"),
    "ITM2": [dict(ItemCode="clean", CardCode="SC"), dict(ItemCode="clean", CardCode="SD")],
    "OITW": dict(ItemCode="clean", WhsCode="W1", MinLevel=1, MaxLevel=9, OnHand=5, IsCommited=0),
    "OINM": dict(
        ItemCode="clean", Warehouse="W1", TransType=59, BASE_REF="1", DocDate=DAY, InQty=5, OutQty=0
    ),
    "OBIN": dict(AbsEntry=1, BinCode="BIN1"),
    "OIBQ": dict(ItemCode="clean", WhsCode="W1", BinAbs=1),
    "OITT": dict(Code="clean", Name="v0", TreeType="P", ToWH="W1", Qauntity=1),
    "ITT1": dict(Father="clean", Code="part", Quantity=1, IssueMthd="M"),
}
PART = dict(CLEAN["OITM"], ItemCode="part", ItemName="clean part")
# PUR-01 lists every purchased item with a supplier, clean or not.
LISTINGS = {"PUR-01": 2}


def tables(spark, **changed):
    """The clean records, with the rows of some tables replaced."""
    rows = {name: found if isinstance(found, list) else [found] for name, found in CLEAN.items()}
    rows["OITM"] = [CLEAN["OITM"], PART]
    rows["ITM1"] = [CLEAN["ITM1"], dict(CLEAN["ITM1"], ItemCode="part")]
    rows["OINM"] = [CLEAN["OINM"], dict(CLEAN["OINM"], ItemCode="part")]
    rows["ITM2"] = CLEAN["ITM2"] + [dict(row, ItemCode="part") for row in CLEAN["ITM2"]]
    rows.update(changed)

    def typed(name, row):
        return tuple(
            Decimal(row[f.name]) if f.dataType.typeName() == "decimal" and row[f.name] is not None else row[f.name]
            for f in SCHEMAS[name].fields
        )

    return {
        name: spark.createDataFrame([typed(name, row) for row in rows[name]], schema) for name, schema in SCHEMAS.items()
    }


def counts(found):
    return {row.rule_id: row.findings for row in sievecraft.summary(found).collect()}


def test_clean_records_break_no_rule(spark):
    assert counts(sievecraft.findings(tables(spark), AS_OF, details=False)) == LISTINGS


def item(**changes):
    return {"OITM": [dict(CLEAN["OITM"], **changes), PART]}


def partner(**changes):
    return {"OCRD": [dict(CLEAN["OCRD"], **changes)]}


def customer(**changes):
    return {"OCRD": [CLEAN["OCRD"], dict(CLEAN["OCRD"], CardCode="CC", CardName="customer", CardType="C", **changes)]}


def stock(**changes):
    return {"OITW": [dict(CLEAN["OITW"], **changes)]}


def moved(**changes):
    return {"OINM": [dict(CLEAN["OINM"], **changes), dict(CLEAN["OINM"], ItemCode="part")]}


# Rule → a change of the clean records that breaks it, and one just short of that.
BOUNDARIES = {
    "BOM-04": ({"ITT1": [dict(CLEAN["ITT1"], Quantity=0)]}, {"ITT1": [dict(CLEAN["ITT1"], Quantity="0.000001")]}),
    "BOM-05": ({"OITT": [dict(CLEAN["OITT"], TreeType=" ")]}, {"OITT": [dict(CLEAN["OITT"], TreeType="\t")]}),
    "BOM-10": ({"ITT1": [dict(CLEAN["ITT1"], Code="clean")]}, {}),
    "BOM-13": ({"OITT": []}, {}),
    "BOM-14": ({"ITT1": [dict(CLEAN["ITT1"], Code="gone")]}, {}),
    "SUP-01": (item(PrcrmntMtd="B", CardCode=""), item(PrcrmntMtd="B", CardCode=" ")),
    "SUP-02": (item(PrcrmntMtd="B"), {**item(PrcrmntMtd="B"), "POR1": CLEAN["ITM2"]}),
    "SUP-09": (partner(GroupNum=-1), partner(GroupNum=0)),
    "SUP-10": (partner(Currency=""), partner(Currency=" ")),
    "SUP-11": ({"OCPR": []}, {}),
    "SUP-12": (partner(Currency=" "), partner(Currency="")),
    "PUR-02": (item(LastPurPrc="12.000001"), item(LastPurPrc=12)),
    "PUR-05": (item(LeadTime=0), item(LeadTime=-1)),
    "PUR-06": (partner(Currency=" "), partner(Currency="\t")),
    "PUR-08": (item(IsCommited="5.000001"), item(IsCommited=None)),
    "PUR-10": (item(AvgPrice=None), item(AvgPrice="0.000001")),
    "ITM-02": (item(UgpEntry=91), {}),
    "ITM-07": ({"ITM2": CLEAN["ITM2"][:1]}, {"ITM2": []}),
    "ITM-12": (stock(MinLevel=10), stock(MinLevel=9)),
    "ITM-14": (item(UpdateDate=datetime.date(1999, 7, 31)), item(UpdateDate=datetime.date(1999, 8, 1))),
    "ITM-16": (item(ItemName="  ab "), item(ItemName=" abc ")),
    "ITM-20": (moved(DocDate=datetime.date(2000, 7, 31)), moved(DocDate=datetime.date(2000, 8, 1))),
    "SAL-03": ({"OPLN": [dict(CLEAN["OPLN"], ValidTo=DAY)]}, {"OPLN": [dict(CLEAN["OPLN"], ValidTo=AS_OF)]}),
    "SAL-05": (customer(GroupNum=0), customer(GroupNum=1)),
    "SAL-08": (item(SalUnitMsr="BX"), item(SalUnitMsr=None)),
    "SAL-A1": (customer(Balance="100.000001"), customer(Balance=100)),
    "SAL-A6": (item(LastPurPrc="12.000001"), item(LastPurPrc=12)),
    "STK-01": (stock(OnHand=6), stock(OnHand=None)),
    "STK-02": (stock(OnHand=-1), stock(OnHand=0)),
    "STK-03": ({"OBIN": [dict(CLEAN["OBIN"], BinCode=" ")]}, {"OBIN": [dict(CLEAN["OBIN"], BinCode="\t")]}),
    "STK-04": (
        moved(OutQty=5, DocDate=datetime.date(2001, 5, 3)), moved(OutQty=5, DocDate=datetime.date(2001, 5, 2))
    ),
    "STK-05": (stock(IsCommited="0.000001"), stock(IsCommited=0)),
    "STK-06": (moved(DocDate=datetime.date(2000, 7, 31)), moved(DocDate=datetime.date(2000, 8, 1))),
}


@pytest.mark.parametrize("rule_id", list(BOUNDARIES))
def test_boundaries(spark, rule_id):
    broken, fine = BOUNDARIES[rule_id]
    assert sievecraft.check(rule_id, tables(spark, **broken), AS_OF).count() == 1
    assert sievecraft.check(rule_id, tables(spark, **fine), AS_OF).count() == 0


def test_repeated_items_multiply_the_lines_found(spark):
    # Two items of one code and two equal lines: 2 copies of the parent × 2 of the part × 2 lines.
    changed = {
        "OITM": [CLEAN["OITM"], CLEAN["OITM"], PART, PART],
        "ITT1": [dict(CLEAN["ITT1"], Quantity=3), dict(CLEAN["ITT1"], Quantity=None)],
    }
    (row,) = sievecraft.check("BOM-09", tables(spark, **changed), AS_OF).collect()
    assert (row.NbOccurrences, row.QuantiteTotale) == (8, Decimal(12))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", " ", None])), min_size=1, max_size=12
    )
)
def test_member_lists_match_a_plain_count(spark, pairs):
    from pyspark.sql import functions as F

    from sievecraft.operators import duplicates

    expected = {}
    for key, member in pairs:
        expected.setdefault(key, []).append(member)
    df = spark.createDataFrame(pairs, "k string, m string")
    found = {row.k: (row.n, row.members) for row in duplicates(df, {"k": F.col("k")}, "n", {"members": "m"}).collect()}
    assert found == {
        key: (len(members), ", ".join(sorted(m for m in members if m is not None)) if any(m is not None for m in members) else None)
        for key, members in expected.items()
        if len(members) > 1
    }
