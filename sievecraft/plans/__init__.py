"""The catalogue of checks."""

from . import bom, items, purchasing, sales, stock, suppliers  # noqa: F401  (fills the register)
from . import shared  # noqa: F401, I001  (needs the others registered)
from .findings import findings, summary
from .rule import RULES, VARIANTS, RowRule, Rule

__all__ = ["RULES", "VARIANTS", "RowRule", "Rule", "findings", "summary"]
