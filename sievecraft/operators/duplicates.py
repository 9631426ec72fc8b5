"""Operators that find values occurring more than once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bits_of, may_hold


def copies(df: DataFrame, *columns: str, count: str = "copies") -> DataFrame:
    """The distinct rows of ``columns``, each with its number of occurrences.

    A join on such rows carries the factor instead of repeating the other side.
    """
    return df.groupBy(*columns).agg(F.count("*").alias(count))


def duplicates(
    df: DataFrame, keys: Mapping[str, Column], count: str, members: Mapping[str, str] | None = None
) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    ``keys`` maps output names to key expressions; NULL keys form one group.
    ``members`` (output name → column) adds the column's values in order, joined
    by ", ".
    """
    named = [column.alias(name) for name, column in keys.items()]
    if not members:
        found = df.groupBy(*named).agg(F.count("*").alias(count))
    else:
        ((text, member),) = members.items()
        often = df.groupBy(*named).agg(F.count("*").alias("__often")).filter("__often > 1").select(*keys)
        # Only keys that repeat, and very few others, are laid out and put into text.
        df = df.filter(may_hold(bits_of(often), *keys.values()))
        found = _with_members(df.select(*named, F.col(member).alias("__member")), list(keys), count, text)
    return found.filter(F.col(count) > 1)


def _with_members(df: DataFrame, keys: list[str], count: str, text: str) -> DataFrame:
    """Group sizes and ordered member lists without sorting any group in one task.

    Equal members are counted first. The rest is laid out in the order of (key,
    member), so a large group spans several partitions; each partition turns its
    part into text, and the parts of a group are then joined in partition order.
    """
    once = df.groupBy(*keys, "__member").agg(F.count("*").alias("__n"))
    laid_out = once.repartitionByRange(*keys, "__member").withColumn("__part", F.spark_partition_id())
    value = F.col("__member")
    repeated = F.concat(value, F.repeat(F.concat(F.lit(", "), value), (F.col("__n") - 1).cast("int")))
    parts = (
        laid_out.withColumn("__text", repeated)
        .groupBy(*keys, "__part")
        .agg(
            F.expr("listagg(__text, ', ') WITHIN GROUP (ORDER BY __member)").alias("__text"),
            F.sum("__n").alias("__n"),
        )
    )
    return parts.groupBy(*keys).agg(
        F.sum("__n").alias(count),
        F.expr("listagg(__text, ', ') WITHIN GROUP (ORDER BY __part)").alias(text),
    )
