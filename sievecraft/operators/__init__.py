"""Reusable data-quality operators, each from DataFrames to a DataFrame."""

from .bits import bits_of, may_hold
from .cardinality import at_most_one, cardinality
from .duplicates import copies, duplicates
from .filters import compare, missing
from .hierarchy import cycle_members, deeper_than, self_loops
from .marks import Family, Marks, found, key_counts, marked
from .ordering import in_order
from .recency import latest, stale
from .references import attach, orphans, rare_orphans, splittable, status_conflict

__all__ = [
    "Family", "Marks", "at_most_one", "attach", "bits_of", "cardinality", "compare", "copies", "cycle_members", "deeper_than",
    "duplicates", "found", "in_order", "key_counts", "latest", "marked", "may_hold", "missing", "orphans", "rare_orphans", "self_loops",
    "splittable", "stale", "status_conflict",
]
