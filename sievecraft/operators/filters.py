"""Operators that look at one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import is_missing


def missing(
    df: DataFrame, *columns: str, kind: str = "blank", codes: tuple[int, ...] = (), need: str = "any"
) -> DataFrame:
    """Rows with a missing value in any (or all) of ``columns``.

    ``kind`` is "null", "empty", "blank", "zero" or "not_positive"; ``codes``, if
    given, are the numbers that stand for "none" beside NULL.
    """
    return df.filter(is_missing(*columns, kind=kind, codes=codes, need=need))


def compare(df: DataFrame, holds: Column, **measures: Column) -> DataFrame:
    """Rows for which a comparison of their columns holds, with what it measures.

    The filter comes first, so it moves on down to the scan and the measures are
    computed for the rows that stay.
    """
    return df.filter(holds).withColumns(measures)
