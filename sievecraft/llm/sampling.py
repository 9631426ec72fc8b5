"""Bounded samples that no task and no driver gathers more than a share of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thinned(rows: DataFrame, share: Column | float, *columns: str) -> DataFrame:
    """The rows whose hash of ``columns`` falls into a ``share``; reruns agree.

    Taking the first n of a sorted table sends n rows of every task to the driver. Thinned to about 2 n rows
    of the whole table before, each task sends a few.
    """
    unit = F.xxhash64(F.lit("sample"), *columns).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return rows.where(unit < share)
