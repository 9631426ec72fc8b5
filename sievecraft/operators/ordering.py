"""Presentation order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, order: Mapping[str, str]) -> DataFrame:
    """Rows sorted by ``order`` (column → "asc" or "desc"), NULL as the lowest value.

    The other columns break ties. That makes the order repeatable and lets the
    range exchange split the rows of one hot sort value over many partitions.
    """
    if not order:
        return df
    named = [
        F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first()
        for name, way in order.items()
    ]
    return df.orderBy(*named, *(F.col(f"`{name}`") for name in df.columns if name not in order))
