"""Column functions on boundary values."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import (
    blank, days_before, days_since, difference, empty, is_missing, label, months_before, or_zero, percentage,
    rounded_product, today, unset, zero, not_positive,
)

DAY = datetime.date(2001, 8, 1)


def values(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


def test_notions_of_missing_text(spark):
    rows = [(None,), ("",), (" ",), ("\t",), ("x",)]
    assert values(spark, rows, "t string", blank("t")) == [True, True, True, False, False]
    assert values(spark, rows, "t string", empty("t")) == [True, True, False, False, False]
    assert values(spark, rows, "t string", is_missing("t", kind="null")) == [True, False, False, False, False]


def test_notions_of_missing_numbers(spark):
    rows = [(None,), (-1,), (0,), (3,)]
    assert values(spark, rows, "n int", zero("n")) == [True, False, True, False]
    assert values(spark, rows, "n int", not_positive("n")) == [True, True, True, False]
    assert values(spark, rows, "n int", unset("n", -1)) == [True, True, False, False]
    assert values(spark, rows, "n int", unset("n", -1, 0)) == [True, True, True, False]


def test_missing_any_or_all(spark):
    rows = [("", ""), ("", "x"), ("x", "x")]
    assert values(spark, rows, "a string, b string", is_missing("a", "b")) == [True, True, False]
    assert values(spark, rows, "a string, b string", is_missing("a", "b", need="all")) == [True, False, False]


def test_days(spark):
    rows = [(DAY - datetime.timedelta(days=365),), (DAY + datetime.timedelta(days=3),), (None,)]
    assert values(spark, rows, "d date", days_since("d", DAY)) == [365, -3, None]
    one = spark.range(1)
    assert one.select(days_before(DAY, 90)).first()[0] == datetime.date(2001, 5, 3)
    assert one.select(months_before(DAY, 24)).first()[0] == datetime.date(1999, 8, 1)
    # A month end meets a shorter month.
    assert one.select(months_before(datetime.date(2001, 3, 31), 1)).first()[0] == datetime.date(2001, 2, 28)
    assert one.select(today(None) == F.current_date()).first()[0]


AMOUNTS = "a decimal(19,6), b decimal(19,6)"


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("1", "3", "33.33"),
        ("2", "3", "66.67"),
        ("1.00005", "100", "1.00"),  # 1.00005 % rounds down
        ("1.005", "100", "1.01"),  # a tie rounds away from zero, which binary fractions would miss
        ("-1.005", "100", "-1.01"),
        ("5", "0", None),
        (None, "5", None),
    ],
)
def test_percentage(spark, a, b, expected):
    row = (a and Decimal(a), Decimal(b))
    assert values(spark, [row], AMOUNTS, percentage("a", "b")) == [expected and Decimal(expected)]


def test_arithmetic(spark):
    rows = [(Decimal("5.5"), Decimal("7")), (None, Decimal("7"))]
    assert values(spark, rows, AMOUNTS, difference("a", "b")) == [Decimal("-1.5"), None]
    assert values(spark, rows, AMOUNTS, or_zero("a")) == [Decimal("5.5"), Decimal(0)]
    assert values(spark, [(Decimal("0.15"), Decimal("0.3"))], AMOUNTS, rounded_product("a", "b")) == [Decimal("0.05")]


def test_label(spark):
    rows = [(13,), (99,), (None,)]
    assert values(spark, rows, "c int", label("c", {13: "bill", 14: "credit"}, "other")) == ["bill", "other", "other"]
    assert values(spark, rows, "c int", label("c", {}, "other")) == ["other"] * 3


@pytest.mark.parametrize(
    "a, b, product",
    [
        ("0.000005", "999.999999", "0.00"), ("0.005", "1", "0.01"), ("-0.005", "1", "-0.01"), ("-0.004999", "1", "0.00"),
        ("0.1", "0.05", "0.01"), ("-0.1", "-0.05", "0.01"), ("9999999999999.999999", "1", "10000000000000.00"), (None, "1", None),
    ],
)
def test_products_are_rounded_once(spark, a, b, product):
    row = [tuple(None if x is None else Decimal(x) for x in (a, b))]
    found = values(spark, row, "a decimal(19,6), b decimal(19,6)", rounded_product("a", "b"))
    assert found == [None if product is None else Decimal(product)]


@pytest.mark.parametrize(
    "part, whole, percent",
    [
        ("400000000", "8000000000000.000001", "0.00"), ("400000000", "8000000000000", "0.01"), ("1", "3", "33.33"), ("2", "3", "66.67"),
        ("-1", "8", "-12.50"), ("-0.0005", "10", "-0.01"), ("0.0005", "-10", "-0.01"), ("1", "0", None), ("0", "7", "0.00"),
    ],
)
def test_percentages_are_rounded_once(spark, part, whole, percent):
    row = [(Decimal(part), Decimal(whole))]
    found = values(spark, row, "a decimal(19,6), b decimal(19,6)", percentage("a", "b"))
    assert found == [None if percent is None else Decimal(percent)]
