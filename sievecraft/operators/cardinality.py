"""Operator that bounds how many details a row may have."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .duplicates import copies
from .references import attach, splittable


def cardinality(
    df: DataFrame,
    details: DataFrame,
    on: Mapping[str, str],
    counts: Mapping[str, Column],
    low: int = 0,
    high: int | None = None,
    per_copy: bool = False,
    hot: bool = True,
) -> DataFrame:
    """Distinct rows of ``df`` whose detail counts all lie between ``low`` and ``high``.

    ``counts`` maps output names to aggregates over ``details``, which are computed
    per key before the join. Rows without details count 0. Distinct counts stay as
    they are when rows of ``df`` repeat; for plain counts set ``per_copy``, which
    multiplies them by the number of equal rows, as counting after a join would.
    ``hot=False`` states that no key occurs often in ``df``, as where it is its own code, and
    spares the shuffles for splitting.
    """
    spread = splittable if hot else (lambda rows: rows)
    per_key = details.groupBy(*on.values()).agg(*(c.alias(name) for name, c in counts.items()))

    def in_bounds(name: str) -> Column:
        test = F.col(name) >= low
        return test if high is None else test & (F.col(name) <= high)

    wanted = reduce(and_, [in_bounds(name) for name in counts])
    how = "left" if low <= 0 else "inner"
    carried = {name: name for name in counts}
    if per_copy:
        rows = attach(copies(df, *df.columns, count="__copies"), per_key, on, how, grouped=hot, **carried)
        totals = {name: F.coalesce(F.col(name) * F.col("__copies"), F.lit(0)) for name in counts}
        return rows.withColumns(totals).drop("__copies").filter(wanted)
    # Made distinct after the join, when few rows are left to shuffle for it.
    if how == "inner":
        rows = attach(df, per_key.filter(wanted), on, how, grouped=hot, **carried)
    else:
        rows = attach(df, per_key, on, how, grouped=hot, **carried)
        rows = rows.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in counts}).filter(wanted)
    return spread(rows).distinct()


def at_most_one(
    df: DataFrame, details: DataFrame, on: Mapping[str, str], count: str, column: str, none: bool = True, hot: bool = True
) -> DataFrame:
    """Distinct rows of ``df`` whose details hold one different value of ``column`` at most, or exactly one (``none=False``).

    ``count`` is the name of the column that says how many, 0 or 1; NULL is no value. Values are not told apart: there is one at
    most when the least is the greatest. So each map task sends one row per key, where a distinct count sends
    every (key, value) pair. ``hot=False`` is as for ``cardinality``.
    """
    spread = splittable if hot else (lambda rows: rows)
    per_key = details.groupBy(*on.values()).agg(F.min(column).alias("__least"), F.max(column).alias("__greatest"))
    if not none:
        per_key = per_key.filter("__least = __greatest")
    rows = attach(df, per_key, on, "left" if none else "inner", grouped=hot, __least="__least", __greatest="__greatest")
    if none:
        rows = rows.filter("__least IS NULL OR __least = __greatest")
    counted = F.when(F.col("__least").isNull(), 0).otherwise(1).cast("bigint")
    return spread(rows.withColumn(count, counted).drop("__least", "__greatest")).distinct()
