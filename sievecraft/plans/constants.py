"""Codes, thresholds and labels the checks use."""

from __future__ import annotations

import datetime
from decimal import Decimal

# Codes of the business database.
MADE = "M"
BOUGHT = "B"  # as the supplier and item checks read the procurement method
PURCHASED = "P"  # as the purchasing checks read it
SUPPLIER = "S"
CUSTOMER = "C"
YES = "Y"
NO = "N"
DEFAULT_PRICE_LIST = 1
STOCK_COUNT = 59  # movement type of a stock count

# Thresholds.
PRICE_RISE = Decimal("1.2")
SHORTEST_NAME = 3
DEEPEST_BOM = 5
IDLE_ITEM_MONTHS = 24
IDLE_MOVEMENT_MONTHS = 12
RECENT_DAYS = 90
IDLE_STOCK_DAYS = 365
NEVER_MOVED = datetime.date(1900, 1, 1)

# Labels shown in results.
HAS_BOM = "Oui"
HAS_NO_BOM = "Non"
NO_BARCODE = "NULL"
NO_START = "Date début manquante"
NO_END = "Date fin manquante"
EXPIRED = "Liste expirée"
OTHER_PROBLEM = "Autre problème"
MOVEMENT_TYPES = {
    13: "Facture AR",
    14: "Avoir AR",
    15: "Livraison",
    16: "Retour",
    18: "Facture AP",
    19: "Avoir AP",
    20: "Réception",
    21: "Retour AP",
    59: "Inventaire",
    60: "Sortie marchandise",
    67: "Transfert stock",
}
OTHER_MOVEMENT = "Autre"
