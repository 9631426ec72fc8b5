"""Operators that look a row up in another table.

How a lookup join runs is left to Spark: it broadcasts a side only when its size
is known, from statistics or from a finished shuffle stage, to be under
``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles both sides and
splits partitions that turn out too large (adaptive skew join). Nothing here hints
a broadcast, since every table but the code lists grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bits_of, may_hold

#: Types whose equal values have equal hashes.
HASHED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.DecimalType)


def splittable(df: DataFrame) -> DataFrame:
    """Rows already laid out by a join key, ready to meet a side with hot keys.

    The adaptive skew join splits a hot partition only where both sides come
    straight from an exchange. Rows grouped or joined by the key need no exchange
    and so keep the other side from being split. Spreading them evenly makes the
    join exchange both sides again, for one more shuffle of rows already reduced.
    """
    return df.hint("rebalance")


def _match(on: Mapping[str, str]) -> Column:
    return reduce(and_, [F.col(left) == F.col(f"__{left}") for left in on])


def _afresh(df: DataFrame, side: DataFrame, on: Mapping[str, str]) -> tuple[DataFrame, Column]:
    """``side``, laid out by its key, and a condition that makes the join exchange it and ``df`` again.

    The condition also compares a hash of the key. Rows laid out by the key are not laid out by key and hash, so
    they go through one exchange, where ``splittable`` takes two. Keys whose hashes may differ though they are equal are left to that.
    (With ``spark.sql.requireAllClusterKeysForCoPartition`` off, Spark keeps the layout, and a hot partition whole.)
    """
    pairs = [(df.schema[left].dataType, side.schema[f"__{left}"].dataType) for left in on]
    if not all(a == b and (a == T.StringType() or isinstance(a, HASHED)) for a, b in pairs):
        return splittable(side), _match(on)
    return side, _match(on) & (F.xxhash64(*on) == F.xxhash64(*(f"__{left}" for left in on)))


def _keys(on: Mapping[str, str]) -> list[Column]:
    return [F.col(right).alias(f"__{left}") for left, right in on.items()]


def attach(
    df: DataFrame, ref: DataFrame, on: Mapping[str, str], how: str = "left", grouped: bool = False, **columns: str
) -> DataFrame:
    """``df`` with columns of the matching ``ref`` rows, as ``new name=column``.

    ``on`` maps key columns of ``df`` to those of ``ref``. Repeated keys in ``ref``
    repeat the rows of ``df``: such repeats are defects the checks must show.
    ``grouped`` states that ``ref`` is laid out by its key, as rows grouped by it are, and that a key
    may occur often in ``df``: both sides are exchanged again, so that its partition can be split.
    """
    side = ref.select(*_keys(on), *(F.col(source).alias(name) for name, source in columns.items()))
    side, same = _afresh(df, side, on) if grouped else (side, _match(on))
    return df.join(side, same, how).drop(*(f"__{left}" for left in on))


def orphans(
    df: DataFrame, ref: DataFrame, on: Mapping[str, str], residual: Column | None = None, hot: bool = True
) -> DataFrame:
    """Rows of ``df`` without a match in ``ref``; a NULL key never matches.

    ``residual`` is a further condition a match must meet, over columns of both
    sides. The keys of ``ref`` are made distinct first, so that one that occurs
    very often reaches the join as one row. ``hot=False`` states that no key occurs often in
    ``df`` either, as where the key is its own code, and spares the shuffle for splitting.
    """
    extra = [] if residual is None else [F.col(c) for c in ref.columns if c not in on.values()]
    keys = ref.select(*_keys(on), *extra).distinct()
    keys, same = _afresh(df, keys, on) if hot else (keys, _match(on))
    return df.join(keys, same if residual is None else same & residual, "left_anti")


def rare_orphans(df: DataFrame, ref: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """As ``orphans``, for a large ``df`` with few of them.

    The keys alone, each once, are looked up first. Those without a match come back to a second scan
    of ``df`` as a table of bits, so that of its rows only the orphans, and very few others, are shuffled.
    """
    given = df.select(*on).distinct()
    lost = orphans(given, ref, on, hot=False).select(*(F.col(left).alias(f"__{left}") for left in on))
    same = reduce(and_, [F.col(left).eqNullSafe(F.col(f"__{left}")) for left in on])
    return df.filter(may_hold(bits_of(lost), *on)).join(lost, same, "left_semi")


def status_conflict(
    df: DataFrame, ref: DataFrame, on: Mapping[str, str], conflict: Column, **columns: str
) -> DataFrame:
    """Rows of ``df`` whose ``ref`` row is in a status it must not be in."""
    return attach(df, ref.filter(conflict), on, "inner", **columns)
