"""What counts as a missing value.

The checks know several notions and they are not interchangeable: a single space
is missing as ``blank`` but present as ``empty``. Each test is an OR of plain
comparisons that is never NULL, and the ones without ``trim`` reach a Parquet scan
as pushed filters, which ``coalesce(x, 0) = 0`` would not.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def blank(column: Column | str) -> Column:
    """NULL, or nothing but spaces (a tab is content)."""
    c = _column(column)
    return c.isNull() | (F.trim(c) == "")


def empty(column: Column | str) -> Column:
    """NULL or the empty string; spaces are content."""
    c = _column(column)
    return c.isNull() | (c == "")


def zero(column: Column | str) -> Column:
    """NULL or 0."""
    c = _column(column)
    return c.isNull() | (c == 0)


def not_positive(column: Column | str) -> Column:
    """NULL, 0 or less."""
    c = _column(column)
    return c.isNull() | (c <= 0)


def unset(column: Column | str, *codes: int) -> Column:
    """NULL or one of the codes that stand for "none"."""
    c = _column(column)
    return reduce(or_, [c == code for code in codes], c.isNull())


KINDS = {
    "null": lambda column: _column(column).isNull(),
    "empty": empty,
    "blank": blank,
    "zero": zero,
    "not_positive": not_positive,
}


def is_missing(*columns: Column | str, kind: str = "blank", codes: tuple[int, ...] = (), need: str = "any") -> Column:
    """Any (or all) of the columns missing, in the sense of ``kind`` or of ``codes``."""
    test = (lambda column: unset(column, *codes)) if codes else KINDS[kind]
    return reduce({"any": or_, "all": and_}[need], [test(column) for column in columns])
