"""What a check is, and the register of all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf
from ..operators import in_order

TableMap = Mapping[str, DataFrame]
Shown = str | tuple[str, str] | tuple[str, Callable[[AsOf], Column]]

# Kinds of anomaly.
MISSING = "missing data"
INVALID = "invalid data"
INCONSISTENT = "inconsistent data"
DUPLICATE = "duplicate"
INTEGRITY = "referential integrity"
COMPLEXITY = "excessive complexity"


@dataclass(frozen=True)
class Rule:
    """One check: the rows of the business tables that break it.

    ``key`` names the output columns that identify an offending record; ``order``
    is the presentation order, used when the check runs on its own.
    """

    rule_id: str
    category: str
    title: str
    tables: tuple[str, ...]
    key: tuple[str, ...]
    rows: Callable[[TableMap, AsOf], DataFrame]
    order: Mapping[str, str] = field(default_factory=dict)

    def run(self, tables: TableMap, as_of: AsOf = None, ordered: bool = True) -> DataFrame:
        found = self.rows(tables, as_of)
        return in_order(found, self.order) if ordered else found


@dataclass(frozen=True)
class Source:
    """Rows that several checks look at: a table, or tables joined on their codes."""

    name: str
    tables: tuple[str, ...]
    rows: Callable[[TableMap], DataFrame]


@dataclass(frozen=True)
class RowRule(Rule):
    """A check decided by each row of its source alone.

    Held as a condition and a list of columns. On its own it is a filter that Spark
    moves below the joins of the source; together, all checks of one source share
    its scans and joins.
    """

    source: Source = None
    where: Callable[[AsOf], Column] = None
    show: tuple[Shown, ...] = ()
    # Where not None, equal rows count once; the columns named here tell rows apart beside the shown ones.
    distinct: tuple[str, ...] | None = None
    # How often a row counts.
    times: Callable[[AsOf], Column] | None = None

    def columns(self, as_of: AsOf) -> list[Column | str]:
        return [_shown(item, as_of) for item in self.show]

    def key_columns(self, as_of: AsOf) -> list[Column]:
        named = {item if isinstance(item, str) else item[0]: item for item in self.show}
        parts = [_shown(named[name], as_of) for name in self.key]
        return [F.col(part) if isinstance(part, str) else part for part in parts]


def _shown(item: Shown, as_of: AsOf) -> Column | str:
    if isinstance(item, str):
        return item
    name, source = item
    return (F.col(source) if isinstance(source, str) else source(as_of)).alias(name)


@dataclass(frozen=True)
class KeyRule:
    """How a check that counts rows by key takes part in a count of many such checks.

    ``keys`` maps shown columns to key expressions over the rows of a table that meet ``where``. Keys with at least ``least``
    rows are findings, and ``count``, if any, is the column that shows how many.
    """

    rule: Rule
    table: str
    keys: Mapping[str, Callable[[], Column]]
    count: str | None = None
    where: Callable[[], Column] | None = None
    least: int = 2


RULES: dict[str, Rule] = {}
# How checks with a plan of their own take part in a pass or a count that several checks share.
SHARED: dict[str, RowRule] = {}
KEYED: dict[str, KeyRule] = {}
# For a source the one that holds its rows among others, and which they are.
WIDER: dict[str, tuple[Source, Callable[[], Column]]] = {}
# Checks of what the title of a rule promises, where its condition tests less.
VARIANTS: dict[str, Rule] = {}


def _register(found: Rule, variant: bool = False) -> Rule:
    if found.rule_id in RULES or found.rule_id in VARIANTS:
        raise ValueError(f"{found.rule_id} is registered twice")
    (VARIANTS if variant else RULES)[found.rule_id] = found
    return found


def rule(
    rule_id: str,
    category: str,
    title: str,
    tables: str,
    key: str,
    order: Mapping[str, str] | None = None,
    variant: bool = False,
) -> Callable[[Callable[[TableMap, AsOf], DataFrame]], Rule]:
    """Register the decorated function, from tables and reporting day to rows."""

    def wrap(rows: Callable[[TableMap, AsOf], DataFrame]) -> Rule:
        return _register(
            Rule(rule_id, category, title, tuple(tables.split()), tuple(key.split()), rows, order or {}), variant
        )

    return wrap


def shared(
    rule_id: str,
    source: Source,
    where: Callable[[AsOf], Column],
    show: tuple[Shown, ...],
    distinct: tuple[str, ...] | None = None,
    times: Callable[[AsOf], Column] | None = None,
) -> None:
    """State a registered check as one of the rows of a source, for a pass that it shares with others."""
    own = RULES[rule_id]
    SHARED[rule_id] = RowRule(
        own.rule_id, own.category, own.title, source.tables, own.key, own.rows, own.order, source, where, show, distinct, times
    )


def keyed(rule_id: str, table: str, keys: Mapping[str, Callable[[], Column]], count: str | None = None, **more: object) -> None:
    """State a registered check as a count of keys of a table."""
    KEYED[rule_id] = KeyRule(RULES[rule_id], table, keys, count, **more)


def row_rule(
    rule_id: str,
    category: str,
    title: str,
    source: str | Source,
    where: Callable[[AsOf], Column],
    show: tuple[Shown, ...],
    key: str | None = None,
    order: Mapping[str, str] | None = None,
) -> RowRule:
    """Register a check of single rows; the first shown column is its key by default."""
    if isinstance(source, str):
        source = Source(source, (source,), lambda tables, name=source: tables[name])
    first = show[0] if isinstance(show[0], str) else show[0][0]
    keys = tuple(key.split()) if key else (first,)

    def rows(tables: TableMap, as_of: AsOf) -> DataFrame:
        return source.rows(tables).filter(where(as_of)).select(*(_shown(item, as_of) for item in show))

    return _register(
        RowRule(rule_id, category, title, source.tables, keys, rows, order or {}, source, where, show)
    )
