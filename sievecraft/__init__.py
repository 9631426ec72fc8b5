"""Data-quality checks of business master and transaction data, on Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .functions import AsOf
from .plans import RULES, VARIANTS, RowRule, Rule, findings, summary
from .sources import DerivedTables, from_database, from_folder


def check(rule_id: str, tables: Mapping[str, DataFrame], as_of: AsOf = None) -> DataFrame:
    """The rows that break one rule, in its presentation order.

    ``as_of`` is the day that stands for today; None means the current date.
    """
    found = RULES.get(rule_id) or VARIANTS[rule_id]
    return found.run(tables, as_of)


__all__ = [
    "RULES", "VARIANTS", "DerivedTables", "RowRule", "Rule", "check", "findings", "from_database", "from_folder",
    "summary",
]
