"""Operators on the newest of many dated rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .references import attach


def stale(
    df: DataFrame, facts: DataFrame, on: Mapping[str, str], date: str, before: Column, last: str, hot: bool = True
) -> DataFrame:
    """Rows of ``df`` with no fact, or whose newest fact lies before a day.

    The newest date, NULL without a fact, is added as ``last``. Facts are reduced
    to one row per key, each map task first, before anything is joined. ``hot=False``
    states that no key occurs often in ``df``, and spares the shuffle for splitting.
    """
    newest = facts.groupBy(*on.values()).agg(F.max(date).alias(last))
    rows = attach(df, newest, on, "left", grouped=hot, **{last: last})
    return rows.filter(F.col(last).isNull() | (F.col(last) < before))


def latest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one row per key in each map task before the shuffle
    (WindowGroupLimit), so a hot key does not travel whole.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first)))
    return ranked.filter("__rank = 1").drop("__rank")
