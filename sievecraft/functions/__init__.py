"""Column functions the checks are written with."""

from .dates import AsOf, days_before, days_since, months_before, today
from .measures import difference, label, or_zero, percentage, rounded_product
from .predicates import blank, empty, is_missing, not_positive, unset, zero

__all__ = [
    "AsOf", "blank", "days_before", "days_since", "difference", "empty", "is_missing", "label", "months_before",
    "not_positive", "or_zero", "percentage", "rounded_product", "today", "unset", "zero",
]
