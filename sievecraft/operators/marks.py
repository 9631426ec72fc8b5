"""Mark joins and tagged counts: what several checks ask, answered by one join or one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .references import attach


@dataclass(frozen=True)
class Marks:
    """What the rows of a table tell about each of their keys.

    ``on`` maps key names to columns of ``rows``. ``marks`` maps names to an aggregate function and
    its inputs; it must skip NULL, as max, min, count and bool_and do.
    """

    rows: DataFrame
    on: Mapping[str, str]
    marks: Mapping[str, tuple[Callable[..., Column], Sequence[Column]]]


def found() -> tuple[Callable[..., Column], Sequence[Column]]:
    """A mark that is true for keys that occur and NULL for others."""
    return F.max, [F.lit(True)]


def marked(df: DataFrame, on: Mapping[str, str], *tables: Marks, hot: bool = True) -> DataFrame:
    """``df`` with the marks of all ``tables``; NULL where a table says nothing about the key.

    ``on`` maps columns of ``df`` to the key names of ``tables``. Rows of all tables become rows of one, tagged by the columns
    they fill, so a single aggregate, which combines before its shuffle, and a single join answer
    for all of them. No row of ``df`` is lost or repeated; a NULL key has no marks. ``hot=False`` states that no key
    occurs often in ``df``, and spares the shuffle for splitting.
    """
    keys = {name: f"__key_{name}" for name in on.values()}
    aggregates, branches = [], []
    for at, table in enumerate(tables):
        columns = [F.col(table.on[name]).alias(key) for name, key in keys.items()]
        for name, (how, inputs) in table.marks.items():
            given = [f"__{at}_{name}_{k}" for k in range(len(inputs))]
            columns += [value.alias(own) for value, own in zip(inputs, given, strict=True)]
            aggregates.append(how(*given).alias(name))
        branches.append(table.rows.select(*columns).dropna(subset=list(keys.values())))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    per_key = rows.groupBy(*keys.values()).agg(*aggregates)
    marks = [name for table in tables for name in table.marks]
    return attach(df, per_key, {column: keys[name] for column, name in on.items()}, grouped=hot, **{name: name for name in marks})


@dataclass(frozen=True)
class Family:
    """Keys to be counted under a name: texts of ``key`` over the rows that meet ``where``."""

    name: str
    key: Sequence[Column]
    where: Column | None = None


def key_counts(*tables: tuple[DataFrame, Sequence[Family]]) -> DataFrame:
    """``family``, ``key`` (array of texts, NULL where the key part is) and ``rows`` for every key of every family.

    Each table is read once: a row becomes one (family, key) row for each family it counts in, and one
    aggregate, which combines before its shuffle, counts them all.
    """
    spread = []
    for df, families in tables:
        tagged = []
        for family in families:
            texts = F.array(*(part.cast("string") for part in family.key))
            row = F.struct(F.lit(family.name).alias("family"), texts.alias("key"))
            tagged.append(row if family.where is None else F.when(family.where, row))
        # Rows that count in no family are dropped at the scan.
        conditions = [family.where for family in families]
        read = df if any(c is None for c in conditions) else df.filter(reduce(lambda a, b: a | b, conditions))
        spread.append(read.select(F.explode(F.array_compact(F.array(*tagged))).alias("row")).select("row.*"))
    return reduce(DataFrame.unionAll, spread).groupBy("family", "key").agg(F.count("*").alias("rows"))
