"""Declared columns of the business tables: those the checks read, no others."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT = T.StringType()
CODE = T.IntegerType()
AMOUNT = T.DecimalType(19, 6)
DAY = T.DateType()


def _columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


# Table and column names, as the business database spells them
# ("Qauntity" and "IsCommited" included).
SCHEMAS: dict[str, T.StructType] = {
    # items
    "OITM": _columns(
        ItemCode=TEXT, ItemName=TEXT, PrcrmntMtd=TEXT, CardCode=TEXT, validFor=TEXT, SellItem=TEXT,
        PrchseItem=TEXT, InvntryUom=TEXT, SalUnitMsr=TEXT, BuyUnitMsr=TEXT, NumInBuy=AMOUNT, UgpEntry=CODE,
        IUoMEntry=CODE, ItmsGrpCod=CODE, TaxCodeAP=TEXT, LeadTime=CODE, OrdrIntrvl=CODE, MinOrdrQty=AMOUNT,
        DfltWH=TEXT, CodeBars=TEXT, SWeight1=AMOUNT, SHeight1=AMOUNT, SWidth1=AMOUNT, SLength1=AMOUNT,
        AvgPrice=AMOUNT, LastPurPrc=AMOUNT, OnHand=AMOUNT, IsCommited=AMOUNT, UpdateDate=DAY,
    ),
    # business partners: suppliers and customers
    "OCRD": _columns(
        CardCode=TEXT, CardName=TEXT, CardType=TEXT, validFor=TEXT, GroupCode=CODE, GroupNum=CODE,
        ShipType=CODE, Currency=TEXT, Address=TEXT, MailAddres=TEXT, City=TEXT, Country=TEXT,
        LicTradNum=TEXT, Phone1=TEXT, Cellular=TEXT, E_Mail=TEXT, Balance=AMOUNT, CreditLine=AMOUNT,
        CreateDate=DAY,
    ),
    # contact persons
    "OCPR": _columns(CardCode=TEXT, CntctCode=CODE),
    # currencies
    "OCRN": _columns(CurrCode=TEXT),
    # item groups
    "OITB": _columns(ItmsGrpCod=CODE),
    # units of a unit-of-measure group
    "UGP1": _columns(UgpEntry=CODE, UomEntry=CODE),
    # price lists
    "OPLN": _columns(ListNum=CODE, ListName=TEXT, ValidFrom=DAY, ValidTo=DAY),
    # item prices by list
    "ITM1": _columns(ItemCode=TEXT, PriceList=CODE, Price=AMOUNT, Currency=TEXT),
    # purchase-order lines
    "POR1": _columns(ItemCode=TEXT, CardCode=TEXT),
    # suppliers listed for an item
    "ITM2": _columns(ItemCode=TEXT, CardCode=TEXT),
    # items by warehouse
    "OITW": _columns(
        ItemCode=TEXT, WhsCode=TEXT, MinLevel=AMOUNT, MaxLevel=AMOUNT, OnHand=AMOUNT, IsCommited=AMOUNT
    ),
    # stock movements
    "OINM": _columns(
        ItemCode=TEXT, Warehouse=TEXT, TransType=CODE, BASE_REF=TEXT, DocDate=DAY, InQty=AMOUNT, OutQty=AMOUNT
    ),
    # bins
    "OBIN": _columns(AbsEntry=CODE, BinCode=TEXT),
    # bin quantities
    "OIBQ": _columns(ItemCode=TEXT, WhsCode=TEXT, BinAbs=CODE),
    # bill-of-material headers
    "OITT": _columns(Code=TEXT, Name=TEXT, TreeType=TEXT, ToWH=TEXT, Qauntity=AMOUNT),
    # bill-of-material lines
    "ITT1": _columns(Father=TEXT, Code=TEXT, Quantity=AMOUNT, IssueMthd=TEXT),
}
