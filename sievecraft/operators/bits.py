"""A table of bits: which keys a few rows may have, in a size that does not grow with the data.

The rows of a large table can be tested against it where they are scanned, so that only those that may
match are shuffled for the join that decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: 128 KB, a million bits. With more keys than some hundred thousand most rows pass the test.
WORDS = 1 << 14


def _place(columns: Sequence[Column | str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(64 * WORDS))


def bits_of(keys: DataFrame) -> Column:
    """The table of the keys, the rows of ``keys``, as a scalar subquery; NULL is a key like any other.

    Each task sends a row for a word at most, and one task joins ``WORDS`` rows.
    """
    place = _place(keys.columns)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    # A zero for every word, so that a word is found by its index.
    zeros = keys.sparkSession.range(0, WORDS, 1, 1).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    given = keys.select(F.floor(place / 64).alias("word"), one.alias("bits"))
    words = given.unionAll(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return table.select(F.col("words.bits").alias("words")).scalar()


def may_hold(table: Column, *columns: Column | str) -> Column:
    """Whether the table may hold the key in ``columns``, of the types it was made from: true for all it holds, and for few others."""
    place = _place(columns)
    return F.getbit(F.get(table, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1
