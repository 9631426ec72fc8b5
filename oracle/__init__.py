"""DuckDB counterparts of the checks, for comparison only."""

from sievecraft import RULES

from .statements import AS_OF, STATEMENTS, VARIANTS
from .tables import SOURCES, with_tables


def statement(rule_id: str) -> str:
    """The rows that break one rule."""
    tables, body = STATEMENTS.get(rule_id) or VARIANTS[rule_id]
    return with_tables(tuple(tables.split()), body)


def findings_statement() -> str:
    """Rule, category and record key of every finding of every rule."""
    parts = []
    for rule_id, (_, body) in STATEMENTS.items():
        key = ", ".join(f"coalesce(CAST({column} AS VARCHAR), '')" for column in RULES[rule_id].key)
        parts.append(
            f"SELECT '{rule_id}' AS rule_id, '{RULES[rule_id].category}' AS category,"
            f" concat_ws('|', {key}) AS record_key FROM ({body})"
        )
    return with_tables(tuple(SOURCES), "\nUNION ALL ".join(parts))


def summary_statement() -> str:
    """Number of findings per rule."""
    return (
        "SELECT rule_id, category, count(*) AS findings FROM (\n"
        f"{findings_statement()}\n) GROUP BY rule_id, category"
    )


__all__ = ["AS_OF", "STATEMENTS", "VARIANTS", "findings_statement", "statement", "summary_statement"]
