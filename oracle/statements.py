"""DuckDB statements the checks are compared with.

Written apart from the Spark plans: the joins come first and rows are counted and
reduced after them, where the plans reduce first. ``AS_OF`` stands for today.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"


def pick(table: str, columns: str, where: str) -> str:
    return f"SELECT {columns} FROM {table} WHERE {where}"


def nil(column: str) -> str:
    """NULL or spaces."""
    return f"trim(coalesce({column}, '')) = ''"


def hundredths(part: str, whole: str) -> str:
    """part * 100 / whole, rounded half away from zero to two decimals, in integers."""
    p, w = (f"CAST(CAST({x} AS DECIMAL(38,6)) * 1000000 AS HUGEINT)" for x in (part, whole))
    return (
        f"CASE WHEN {whole} <> 0 THEN CAST(sign({p}) * sign({w})"
        f" * ((2 * abs({p}) * 10000 + abs({w})) // (2 * abs({w}))) AS DECIMAL(38,2)) / 100 END"
    )


MADE, BOUGHT = "PrcrmntMtd = 'M'", "PrcrmntMtd = 'B'"
PURCHASED = "PrcrmntMtd = 'P' AND validFor = 'Y'"
SUPPLIER = "CardType = 'S'"
ACTIVE_SUPPLIER = "CardType = 'S' AND validFor = 'Y'"
ACTIVE_CUSTOMER = "CardType = 'C' AND validFor = 'Y'"
ON_SALE = "SellItem = 'Y' AND validFor = 'Y'"

# Lines of bills of materials with the items they name on both ends.
LINES = (
    "SELECT l.Father AS Parent, p.ItemName AS ParentName, l.Code AS Component, c.ItemName AS ComponentName,"
    " l.Quantity, c.validFor, c.PrcrmntMtd, c.InvntryUom, l.IssueMthd"
    " FROM ITT1 l, OITM p, OITM c WHERE p.ItemCode = l.Father AND c.ItemCode = l.Code"
)
LINE = "Parent, ParentName, Component, ComponentName"
# Headers of bills of materials with their item.
HEADERS = "SELECT h.*, i.ItemName, i.validFor, i.PrcrmntMtd FROM OITT h, OITM i WHERE i.ItemCode = h.Code"
# Warehouse stock with its item.
STOCK = (
    "SELECT i.ItemCode, i.ItemName, i.validFor, i.AvgPrice, w.WhsCode, w.MinLevel, w.MaxLevel, w.OnHand, w.IsCommited"
    " FROM OITM i, OITW w WHERE w.ItemCode = i.ItemCode"
)
# Prices of the default list with their item.
PRICED = (
    "SELECT i.ItemCode, i.ItemName, i.LastPurPrc, i.SellItem, i.validFor, p.PriceList, p.Price, p.Currency"
    " FROM OITM i, ITM1 p WHERE p.ItemCode = i.ItemCode AND p.PriceList = 1"
)

# Rule → tables it reads and the statement over them.
STATEMENTS: dict[str, tuple[str, str]] = {
    "BOM-01": (
        "OITM OITT",
        pick("OITM", "ItemCode, ItemName, PrcrmntMtd", f"{MADE} AND ItemCode NOT IN (SELECT Code FROM OITT)"),
    ),
    "BOM-02": (
        "OITM OITT ITT1",
        f"SELECT Code AS Parent, ItemName AS ParentName, TreeType FROM ({HEADERS})"
        " WHERE Code NOT IN (SELECT Father FROM ITT1)",
    ),
    "BOM-03": ("OITM ITT1", pick(f"({LINES})", f"{LINE}, validFor, Quantity", "validFor = 'N'")),
    "BOM-04": ("OITM ITT1", pick(f"({LINES})", f"{LINE}, Quantity", "NOT coalesce(Quantity > 0, FALSE)")),
    "BOM-05": ("OITM OITT", pick(f"({HEADERS})", "Code, ItemName AS Name, TreeType", nil("TreeType"))),
    "BOM-06": ("OITM OITT", pick(f"({HEADERS})", "Code, ItemName AS Name, ToWH AS EntrepotProduction", nil("ToWH"))),
    "BOM-07": (
        "OITM OITT",
        pick(f"({HEADERS})", "Code AS Parent, ItemName AS ParentName, validFor, TreeType", "validFor = 'N'"),
    ),
    "BOM-08": (
        "OITT",
        "SELECT Code AS Parent, count(*) AS NbVersions, string_agg(Name, ', ' ORDER BY Name) AS Versions"
        " FROM OITT GROUP BY Parent HAVING NbVersions > 1",
    ),
    "BOM-09": (
        "OITM ITT1",
        f"SELECT {LINE}, count(*) AS NbOccurrences, CAST(sum(Quantity) AS DECIMAL(38,6)) AS QuantiteTotale"
        f" FROM ({LINES}) GROUP BY ALL HAVING NbOccurrences > 1",
    ),
    "BOM-10": ("OITM ITT1", pick(f"({LINES})", f"DISTINCT {LINE}, Quantity", "Parent = Component")),
    "BOM-11": (
        "OITM ITT1",
        pick(f"({LINES})", f"{LINE}, Quantity, InvntryUom AS UoM_Article, IssueMthd AS Methode_Sortie", "FALSE"),
    ),
    "BOM-12": (
        "OITM OITT",
        pick(
            f"({HEADERS})", "Code AS Parent, ItemName AS ParentName, TreeType, Qauntity AS QuantiteBase",
            "NOT coalesce(Qauntity > 0, FALSE)",
        ),
    ),
    "BOM-13": (
        "OITM OITT ITT1",
        "SELECT Father AS ParentInexistant, l.Code AS Component, ItemName AS ComponentName, Quantity"
        " FROM ITT1 l JOIN OITM ON ItemCode = l.Code WHERE Father NOT IN (SELECT Code FROM OITT)",
    ),
    "BOM-14": (
        "OITM ITT1",
        "SELECT Father AS Parent, ItemName AS ParentName, Code AS ComponentInexistant, Quantity"
        " FROM ITT1 JOIN OITM ON ItemCode = Father WHERE Code NOT IN (SELECT ItemCode FROM OITM)",
    ),
    "BOM-15": (
        "OITM OITT ITT1",
        f"SELECT {LINE}, PrcrmntMtd AS ComponentProcurement, Quantity,"
        " CASE WHEN h.Code IS NULL THEN 'Non' ELSE 'Oui' END AS A_SousBOM"
        f" FROM ({LINES}) l LEFT JOIN OITT h ON h.Code = Component WHERE {MADE}",
    ),
    "SUP-01": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, PrcrmntMtd, CardCode AS FournisseurParDefaut",
            f"{BOUGHT} AND coalesce(CardCode, '') = ''",
        ),
    ),
    "SUP-02": (
        "OITM POR1",
        "SELECT i.ItemCode, ItemName, i.CardCode AS FournisseurPrincipal,"
        " count(DISTINCT o.CardCode) AS NbFournisseursDifferents"
        " FROM OITM i LEFT JOIN POR1 o USING (ItemCode)"
        f" WHERE {BOUGHT} AND length(i.CardCode) > 0 GROUP BY ALL HAVING NbFournisseursDifferents < 2",
    ),
    "SUP-03": (
        "OITM OCRD",
        "SELECT ItemCode, ItemName, CardCode, CardName, b.validFor FROM OITM i JOIN OCRD b USING (CardCode)"
        f" WHERE {BOUGHT} AND {SUPPLIER} AND b.validFor = 'N'",
    ),
    "SUP-04": (
        "OCRD",
        pick(
            "OCRD", "CardCode, CardName, Address, MailAddres",
            f"{SUPPLIER} AND coalesce(Address, '') = '' AND coalesce(MailAddres, '') = ''",
        ),
    ),
    "SUP-05": (
        "OITM OCRD",
        "SELECT ItemCode, ItemName, CardCode AS Fournisseur, CardName, BuyUnitMsr, NumInBuy"
        f" FROM OITM LEFT JOIN OCRD USING (CardCode) WHERE {BOUGHT} AND length(CardCode) > 0",
    ),
    "SUP-06": (
        "OITM OCRD",
        "SELECT ItemCode, ItemName, CardCode AS Fournisseur, CardName, LeadTime, OrdrIntrvl, MinOrdrQty"
        f" FROM OITM LEFT JOIN OCRD USING (CardCode) WHERE {BOUGHT} AND coalesce(LeadTime, 0) = 0",
    ),
    "SUP-07": (
        "OCRD",
        f"SELECT CardCode, count(*) AS NombreOccurrences FROM OCRD WHERE {SUPPLIER}"
        " GROUP BY CardCode HAVING NombreOccurrences > 1",
    ),
    "SUP-08": (
        "OCRD",
        "SELECT upper(CardName) AS NomNormalise, string_agg(CardCode, ', ' ORDER BY CardCode) AS Codes,"
        f" count(*) AS NombreOccurrences FROM OCRD WHERE {SUPPLIER} GROUP BY NomNormalise HAVING NombreOccurrences > 1",
    ),
    "SUP-08b": (
        "OCRD",
        "SELECT upper(CardName) AS NomNormalise, count(*) AS NombreOccurrences FROM OCRD"
        f" WHERE {SUPPLIER} GROUP BY NomNormalise HAVING NombreOccurrences > 1",
    ),
    "SUP-09": ("OCRD", pick("OCRD", "CardCode, CardName, GroupNum", f"{SUPPLIER} AND coalesce(GroupNum, -1) = -1")),
    "SUP-10": ("OCRD", pick("OCRD", "CardCode, CardName, Currency", f"{SUPPLIER} AND coalesce(Currency, '') = ''")),
    "SUP-11": (
        "OCRD OCPR",
        pick(
            "OCRD", "CardCode, CardName, Phone1, E_Mail", f"{SUPPLIER} AND CardCode NOT IN (SELECT CardCode FROM OCPR)"
        ),
    ),
    "SUP-12": (
        "OCRD OCRN",
        pick(
            "OCRD", "CardCode, CardName, Currency AS DeviseInvalide",
            f"{SUPPLIER} AND length(Currency) > 0 AND Currency NOT IN (SELECT CurrCode FROM OCRN)",
        ),
    ),
    "SUP-13": (
        "OITM OCRD",
        pick(
            "OITM", "ItemCode, ItemName, CardCode AS FournisseurInexistant",
            f"{BOUGHT} AND length(CardCode) > 0 AND CardCode NOT IN (SELECT CardCode FROM OCRD)",
        ),
    ),
    "PUR-01": (
        "OITM OCRD",
        "SELECT ItemCode, ItemName, i.CardCode AS FournisseurPrincipal, CardName"
        f" FROM (SELECT * FROM OITM WHERE {PURCHASED} AND CardCode IS NOT NULL) i LEFT JOIN OCRD b ON b.CardCode = i.CardCode",
    ),
    "PUR-02": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, AvgPrice AS PrixMoyenActuel, LastPurPrc AS DernierPrixAchat",
            f"{PURCHASED} AND AvgPrice > 0 AND LastPurPrc * 10 > AvgPrice * 12",
        ),
    ),
    "PUR-03": (
        "OCRD",
        pick("OCRD", "CardCode, CardName, GroupCode, GroupNum", f"{ACTIVE_SUPPLIER} AND coalesce(GroupNum, -1) = -1"),
    ),
    "PUR-04": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, TaxCodeAP AS TaxCode, PrcrmntMtd",
            f"PrcrmntMtd IN ('M', 'P') AND validFor = 'Y' AND {nil('TaxCodeAP')}",
        ),
    ),
    "PUR-05": (
        "OITM OCRD",
        "SELECT ItemCode, ItemName, LeadTime AS DelaisArticle, i.CardCode AS FournisseurPrincipal, CardName"
        f" FROM (SELECT * FROM OITM WHERE {PURCHASED} AND coalesce(LeadTime, 0) = 0) i"
        " LEFT JOIN OCRD b ON b.CardCode = i.CardCode",
    ),
    "PUR-06": (
        "OCRD", pick("OCRD", "CardCode, CardName, Currency, GroupCode", f"{ACTIVE_SUPPLIER} AND {nil('Currency')}")
    ),
    "PUR-07": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, CardCode AS FournisseurPrincipal, PrcrmntMtd",
            f"{PURCHASED} AND {nil('CardCode')}",
        ),
    ),
    "PUR-08": (
        "OITM OCRD",
        "SELECT ItemCode, ItemName, OnHand AS StockPhysique, IsCommited AS Engage,"
        " CAST(OnHand - IsCommited AS DECIMAL(20,6)) AS StockDisponible, i.CardCode AS FournisseurPrincipal, CardName"
        f" FROM (SELECT * FROM OITM WHERE {PURCHASED} AND IsCommited > OnHand) i"
        " LEFT JOIN OCRD b ON b.CardCode = i.CardCode",
    ),
    "PUR-09": (
        "OCRD",
        pick(
            "OCRD", "CardCode, CardName, Address, City, Country",
            f"{ACTIVE_SUPPLIER} AND ({nil('City')} OR {nil('Country')})",
        ),
    ),
    "PUR-10": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, AvgPrice, LastPurPrc AS DernierPrixAchat, CardCode AS FournisseurPrincipal",
            f"{PURCHASED} AND coalesce(AvgPrice, 0) = 0",
        ),
    ),
    "ITM-01": ("OITM", pick("OITM", "ItemCode, ItemName, InvntryUom", nil("InvntryUom"))),
    "ITM-02": (
        "OITM UGP1",
        "SELECT ItemCode, ItemName, InvntryUom, UgpEntry, CAST(NULL AS INTEGER) AS UomEntry FROM OITM i"
        " WHERE NOT EXISTS (FROM UGP1 u WHERE u.UgpEntry = i.UgpEntry AND u.UomEntry <> i.IUoMEntry)",
    ),
    "ITM-03": ("OITM", pick("OITM", "ItemCode, ItemName, ItmsGrpCod", "ItmsGrpCod IS NULL")),
    "ITM-04": ("OITM", "SELECT ItemCode, count(*) AS NbDoublons FROM OITM GROUP BY ALL HAVING NbDoublons > 1"),
    "ITM-05": ("OITM", "SELECT ItemName, count(*) AS NbDoublons FROM OITM GROUP BY ALL HAVING NbDoublons > 1"),
    "ITM-06": ("OITM", pick("OITM", "ItemCode, ItemName", f"PrchseItem = 'Y' AND {nil('CardCode')}")),
    "ITM-07": (
        "OITM ITM2",
        "SELECT ItemCode, ItemName, count(DISTINCT s.CardCode) AS NbFournisseurs"
        " FROM OITM JOIN ITM2 s USING (ItemCode) WHERE PrchseItem = 'Y' AND length(trim(s.CardCode)) > 0"
        " GROUP BY ALL HAVING NbFournisseurs = 1",
    ),
    "ITM-08": ("OITM", pick("OITM", "ItemCode, ItemName, PrcrmntMtd", nil("PrcrmntMtd"))),
    "ITM-09": (
        "OITM OITT", pick("OITM", "ItemCode, ItemName", f"{MADE} AND ItemCode NOT IN (SELECT Code FROM OITT)")
    ),
    "ITM-10": ("OITM OITT", pick(f"({HEADERS})", "Code AS ItemCode, ItemName", BOUGHT)),
    "ITM-11": (
        "OITM OITW",
        pick(
            f"({STOCK})", "ItemCode, ItemName, WhsCode, MinLevel, MaxLevel",
            "coalesce(MinLevel, 0) = 0 OR coalesce(MaxLevel, 0) = 0",
        ),
    ),
    "ITM-12": (
        "OITM OITW", pick(f"({STOCK})", "ItemCode, ItemName, WhsCode, MinLevel, MaxLevel", "MinLevel > MaxLevel")
    ),
    "ITM-13": ("OITM", pick("OITM", "ItemCode, ItemName, validFor AS ValidFor, UpdateDate", "validFor = 'N'")),
    "ITM-14": (
        "OITM",
        pick(
            "OITM", f"ItemCode, ItemName, UpdateDate, date_diff('day', UpdateDate, {AS_OF}) AS JoursInactivite",
            f"UpdateDate < {AS_OF} - INTERVAL 2 YEAR",
        ),
    ),
    "ITM-15": ("OITM", pick("OITM", "ItemCode, ItemName, DfltWH AS EntrepotDefaut", nil("DfltWH"))),
    "ITM-16": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, length(ItemName) AS LongueurNom", "length(trim(coalesce(ItemName, ''))) < 3"
        ),
    ),
    "ITM-17": ("OITM", pick("OITM", "ItemCode, ItemName, coalesce(CodeBars, 'NULL') AS CodeBarres", nil("CodeBars"))),
    "ITM-18": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, SWeight1, SHeight1, SWidth1, SLength1",
            "coalesce(SWeight1, 0) = 0 OR coalesce(SHeight1, 0) = 0 OR coalesce(SWidth1, 0) = 0"
            " OR coalesce(SLength1, 0) = 0",
        ),
    ),
    "ITM-19": (
        "OITM OITT", pick(f"({HEADERS})", "Code AS CodeParent, ItemName, validFor AS ValidFor", "validFor = 'N'")
    ),
    "ITM-20": (
        "OITM OINM",
        "SELECT ItemCode, ItemName, max(DocDate) AS DernierMouvement FROM OITM LEFT JOIN OINM USING (ItemCode)"
        f" GROUP BY ALL HAVING coalesce(DernierMouvement < {AS_OF} - INTERVAL 1 YEAR, TRUE)",
    ),
    "ITM-21": (
        "OITM OITW",
        "SELECT ItemCode, ItemName, count(DISTINCT WhsCode) AS NbEntrepots,"
        " count(DISTINCT concat(coalesce(MinLevel, 0), '/', coalesce(MaxLevel, 0))) AS NbParamSets"
        f" FROM ({STOCK}) GROUP BY ALL HAVING NbEntrepots > 1 AND NbParamSets > 1",
    ),
    "SAL-01": (
        "OCRD", pick("OCRD", "CardCode, CardName, Address, Phone1, E_Mail", f"{ACTIVE_CUSTOMER} AND {nil('Address')}")
    ),
    "SAL-02": (
        "OCRD",
        pick("OCRD", "CardCode, CardName, LicTradNum, Address, Country", f"{ACTIVE_CUSTOMER} AND {nil('LicTradNum')}"),
    ),
    "SAL-03": (
        "OPLN",
        pick(
            "OPLN",
            "ListNum, ListName, ValidFrom, ValidTo, CASE WHEN ValidFrom IS NULL THEN 'Date début manquante'"
            " WHEN ValidTo IS NULL THEN 'Date fin manquante' ELSE 'Liste expirée' END AS TypeProbleme,"
            f" date_diff('day', ValidTo, {AS_OF}) AS JoursDepuisExpiration",
            f"ValidFrom IS NULL OR coalesce(ValidTo < {AS_OF}, TRUE)",
        ),
    ),
    "SAL-04": (
        "OITM ITM1",
        pick(
            "OITM", "ItemCode, ItemName, ItmsGrpCod, OnHand", f"{ON_SALE} AND ItemCode NOT IN (SELECT ItemCode FROM ITM1)"
        ),
    ),
    "SAL-05": (
        "OCRD",
        pick(
            "OCRD", "CardCode, CardName, GroupCode, GroupNum AS ConditionsPaiement, Balance",
            f"{ACTIVE_CUSTOMER} AND coalesce(GroupNum, 0) IN (0, -1)",
        ),
    ),
    "SAL-06": (
        "OCRD",
        pick(
            "OCRD", "CardCode, CardName, ShipType, Address, City", f"{ACTIVE_CUSTOMER} AND coalesce(ShipType, 0) IN (0, -1)"
        ),
    ),
    "SAL-07": (
        "OITM",
        pick("OITM", "DISTINCT ItemCode, ItemName, validFor, SellItem, OnHand", "validFor = 'N' AND SellItem = 'Y'"),
    ),
    "SAL-08": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, InvntryUom AS UniteStock, SalUnitMsr AS UniteVente, BuyUnitMsr AS UniteAchat",
            f"{ON_SALE} AND InvntryUom <> coalesce(SalUnitMsr, InvntryUom)",
        ),
    ),
    "SAL-A1": (
        "OCRD",
        pick(
            "OCRD",
            "CardCode, CardName, CreditLine AS LimiteCredit, Balance AS SoldeActuel,"
            " CAST(Balance - CreditLine AS DECIMAL(20,6)) AS Depassement,"
            f" CAST({hundredths('Balance', 'CreditLine')} AS DECIMAL(38,2)) AS PourcentageUtilisation,"
            " Cellular AS TelMobile",
            f"{ACTIVE_CUSTOMER} AND CreditLine > 0 AND Balance > CreditLine",
        ),
    ),
    "SAL-A2": (
        "OITM ITM1",
        pick(
            f"({PRICED})", "ItemCode, ItemName, PriceList AS ListNum, Price, Currency",
            f"{ON_SALE} AND coalesce(Price, 0) = 0",
        ),
    ),
    "SAL-A3": (
        "OCRD",
        pick(
            "OCRD", "CardCode, CardName, GroupCode, Balance, CreateDate",
            f"{ACTIVE_CUSTOMER} AND coalesce(GroupCode, 0) IN (0, -1)",
        ),
    ),
    "SAL-A4": (
        "OITM",
        pick(
            "OITM", "ItemCode, ItemName, ItmsGrpCod, OnHand, SellItem",
            "validFor = 'Y' AND coalesce(ItmsGrpCod, 0) IN (0, -1)",
        ),
    ),
    "SAL-A5": (
        "OCRD OCPR",
        "SELECT CardCode, CardName, count(CntctCode) AS NombreContacts, E_Mail, Phone1"
        f" FROM OCRD LEFT JOIN OCPR USING (CardCode) WHERE {ACTIVE_CUSTOMER} GROUP BY ALL HAVING NombreContacts >= 2",
    ),
    "SAL-A6": (
        "OITM ITM1",
        pick(
            f"({PRICED})",
            "ItemCode, ItemName, LastPurPrc AS DernierPrixAchat, Price AS PrixVente, PriceList AS NumListe,"
            " CAST(Price - LastPurPrc AS DECIMAL(20,6)) AS Marge,"
            f" CAST({hundredths('(Price - LastPurPrc)', 'LastPurPrc')} AS DECIMAL(38,2)) AS PourcentageMarge",
            f"{ON_SALE} AND LastPurPrc > 0 AND Price < LastPurPrc",
        ),
    ),
    "STK-01": (
        "OITM OITW OINM",
        "SELECT s.ItemCode, ItemName, WhsCode, OnHand, Counted AS DernierInventaire,"
        " CAST(OnHand - Counted AS DECIMAL(20,6)) AS Ecart FROM ("
        f"SELECT s.*, coalesce(n.InQty, CAST(0 AS DECIMAL(19,6))) AS Counted FROM ({STOCK}) s LEFT JOIN ("
        "FROM OINM WHERE TransType = 59"
        " QUALIFY row_number() OVER (PARTITION BY ItemCode, Warehouse ORDER BY DocDate DESC, InQty DESC) = 1) n"
        " ON n.ItemCode = s.ItemCode AND n.Warehouse = s.WhsCode) s WHERE OnHand <> Counted",
    ),
    "STK-02": ("OITM OITW", pick(f"({STOCK})", "ItemCode, ItemName, WhsCode, OnHand", "OnHand < 0")),
    "STK-03": (
        "OITM OITW OIBQ OBIN",
        f"SELECT DISTINCT s.ItemCode, ItemName, s.WhsCode, OnHand FROM ({STOCK}) s"
        " LEFT JOIN OIBQ q ON q.ItemCode = s.ItemCode AND q.WhsCode = s.WhsCode"
        f" LEFT JOIN OBIN b ON b.AbsEntry = q.BinAbs WHERE validFor = 'Y' AND OnHand > 0 AND {nil('BinCode')}",
    ),
    "STK-04": (
        "OITM OINM",
        "SELECT m.ItemCode, ItemName, Warehouse AS WhsCode, BASE_REF AS DocNum, DocDate,"
        " CAST(InQty - OutQty AS DECIMAL(20,6)) AS QuantiteNette, TransType, coalesce(label, 'Autre') AS TypeDocument"
        " FROM OINM m JOIN OITM i ON i.ItemCode = m.ItemCode LEFT JOIN (VALUES (13, 'Facture AR'), (14, 'Avoir AR'),"
        " (15, 'Livraison'), (16, 'Retour'), (18, 'Facture AP'), (19, 'Avoir AP'), (20, 'Réception'), (21, 'Retour AP'),"
        " (59, 'Inventaire'), (60, 'Sortie marchandise'), (67, 'Transfert stock')) k(code, label) ON code = TransType"
        f" WHERE InQty <= OutQty AND date_diff('day', DocDate, {AS_OF}) <= 90",
    ),
    "STK-05": (
        "OITM OITW",
        pick(
            f"({STOCK})",
            "ItemCode, ItemName, WhsCode, IsCommited AS QteEngagee, OnHand AS StockDisponible,"
            f" CAST({hundredths('IsCommited', 'OnHand')} AS DECIMAL(38,2)) AS PourcentageBloque",
            "validFor = 'Y' AND IsCommited > 0",
        ),
    ),
    "STK-06": (
        "OITM OITW OINM",
        "SELECT s.ItemCode, ItemName, WhsCode, OnHand, coalesce(max(DocDate), DATE '1900-01-01') AS DernierMvt,"
        f" date_diff('day', DernierMvt, {AS_OF}) AS JoursSansMouvement,"
        f" CAST(round(OnHand * AvgPrice, 2) AS DECIMAL(38,2)) AS ValeurStock FROM ({STOCK}) s"
        " LEFT JOIN OINM m ON m.ItemCode = s.ItemCode AND m.Warehouse = s.WhsCode"
        " WHERE OnHand > 0 AND validFor = 'Y' GROUP BY s.ItemCode, ItemName, WhsCode, OnHand, AvgPrice"
        " HAVING JoursSansMouvement > 365",
    ),
}


def deep(levels: int) -> str:
    """Parents with a path of more than ``levels`` lines below them."""
    inner = "SELECT Father FROM ITT1"
    return inner if levels == 0 else f"{inner} WHERE Code IN ({deep(levels - 1)})"


VARIANTS: dict[str, tuple[str, str]] = {
    "BOM-10-cycle": (
        "OITM ITT1",
        "SELECT ItemCode AS Parent, ItemName AS ParentName FROM OITM WHERE ItemCode IN ("
        "WITH RECURSIVE below(top, part) AS (SELECT Father, Code FROM ITT1"
        " UNION SELECT top, Code FROM below JOIN ITT1 ON Father = part) SELECT top FROM below WHERE top = part)",
    ),
    "BOM-15-depth": ("OITM ITT1", pick("OITM", "ItemCode AS Parent, ItemName AS ParentName", f"ItemCode IN ({deep(5)})")),
    "SUP-05-price": (
        "OITM ITM1",
        pick(
            "OITM", "ItemCode, ItemName, CardCode AS Fournisseur",
            f"{BOUGHT} AND length(CardCode) > 0 AND ItemCode NOT IN (SELECT ItemCode FROM ITM1 WHERE Price > 0)",
        ),
    ),
    "PUR-01-price": (
        "OITM ITM1",
        pick(
            "OITM", "ItemCode, ItemName, CardCode AS FournisseurPrincipal",
            f"{PURCHASED} AND CardCode IS NOT NULL AND ItemCode NOT IN (SELECT ItemCode FROM ITM1 WHERE Price > 0)",
        ),
    ),
    "ITM-07-none": (
        "OITM ITM2",
        "SELECT ItemCode, ItemName, count(DISTINCT nullif(trim(s.CardCode), '')) AS NbFournisseurs"
        " FROM OITM LEFT JOIN ITM2 s USING (ItemCode) WHERE PrchseItem = 'Y' GROUP BY ALL HAVING NbFournisseurs < 2",
    ),
}
