"""Decimal arithmetic and code labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(a: Column | str, b: Column | str) -> Column:
    """a - b; NULL when either is."""
    return (_column(a) - _column(b)).cast("decimal(20,6)")


def percentage(part: Column | str, whole: Column | str) -> Column:
    """``part`` in percent of ``whole`` to two decimals; NULL when ``whole`` is 0.

    Stays in decimals, so money is never rounded through binary fractions.
    """
    hundredths = _quotient(_millionths(part) * 10_000, F.nullif(_millionths(whole), F.lit(0).cast("decimal(20,0)")))
    return _hundredths(hundredths)


def rounded_product(a: Column | str, b: Column | str) -> Column:
    """a * b to two decimals."""
    product = _millionths(a).cast("decimal(19,0)") * _millionths(b).cast("decimal(19,0)")
    return _hundredths(_quotient(product, F.lit(10**10).cast("decimal(11,0)")))


def _millionths(amount: Column | str) -> Column:
    """The amount as a whole number of its smallest unit."""
    return (_column(amount).cast("decimal(20,6)") * F.lit(10**6).cast("decimal(7,0)")).cast("decimal(20,0)")


def _quotient(number: Column, divisor: Column) -> Column:
    """The whole number nearest to the quotient of two whole numbers, halves away from zero.

    Decided on the remainder: a decimal quotient would be rounded to its own scale first.
    """
    rest = number % divisor
    whole = ((number - rest) / divisor).cast("decimal(30,0)")
    step = F.when((number < 0) == (divisor < 0), F.lit(1)).otherwise(F.lit(-1))
    return F.when(F.abs(rest) >= F.abs(divisor) - F.abs(rest), whole + step).otherwise(whole)


def _hundredths(number: Column) -> Column:
    return (number.cast("decimal(30,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(38,2)")


def or_zero(column: Column | str) -> Column:
    """The amount, or 0 for NULL."""
    return F.coalesce(_column(column), F.lit(0).cast("decimal(19,6)"))


def label(code: Column | str, labels: Mapping[int, str], default: str) -> Column:
    """The text of a code."""
    c = _column(code)
    texts = [F.when(c == value, F.lit(text)) for value, text in labels.items()]
    return F.coalesce(*texts, F.lit(default))


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
