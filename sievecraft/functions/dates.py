"""Dates relative to a reporting day.

``as_of`` is a ``datetime.date``, or None for the current date. All results are
constants to the optimizer, so comparing a column with one can be pushed down.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = datetime.date | None


def today(as_of: AsOf) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def months_before(as_of: AsOf, months: int) -> Column:
    return F.add_months(today(as_of), -months)


def days_before(as_of: AsOf, days: int) -> Column:
    return F.date_sub(today(as_of), days)


def days_since(date: Column | str, as_of: AsOf) -> Column:
    """Whole days from ``date`` to the reporting day, negative for a later date."""
    return F.date_diff(today(as_of), date).cast("bigint")
