"""The derived business tables as DuckDB common table expressions."""

from __future__ import annotations

from sievecraft.sources.derived import COLUMNS

PARTS = "(SELECT *, p_partkey AS k FROM part) p"
PARTNERS = (
    "(SELECT s_suppkey AS k, 'S' AS t, s_acctbal AS bal, s_nationkey AS nk, s_name AS nm FROM supplier"
    " UNION ALL SELECT c_custkey, 'C', c_acctbal, c_nationkey, c_name FROM customer) b"
)
PART_WAREHOUSES = (
    "(SELECT *, p_partkey AS k, n_nationkey AS w FROM part JOIN nation ON (p_partkey + n_nationkey) % 12 = 0) b"
)

# Row sources of FIXTURES.md.
SOURCES = {
    "OITM": PARTS,
    "OCRD": PARTNERS,
    "OCPR": f"{PARTNERS} JOIN region ON r_regionkey < k % 4",
    "OCRN": "region",
    "OITB": "region",
    "UGP1": "region",
    "OPLN": "(SELECT *, n_nationkey AS k FROM nation) b",
    "ITM1": f"{PARTS} JOIN region ON r_regionkey < 2 WHERE k % 16 <> 5",
    "POR1": "lineitem WHERE l_partkey % 20 <> 3",
    "ITM2": "lineitem",
    "OITW": PART_WAREHOUSES,
    "OINM": (
        "(SELECT *, l_partkey AS k FROM lineitem) b"
        " WHERE k % 100 <> 5 AND NOT (k % 10 = 0 AND l_shipdate >= TIMESTAMP '2000-01-01 00:00:00')"
    ),
    "OBIN": "(SELECT *, n_nationkey AS k FROM nation) b",
    "OIBQ": f"{PART_WAREHOUSES} WHERE k % 5 <> 0",
    "OITT": (
        "(SELECT p_partkey AS k, r_regionkey AS v FROM part"
        " JOIN region ON r_regionkey = 0 OR (r_regionkey = 1 AND p_partkey % 70 = 8)) b"
        " WHERE k % 7 IN (0, 1, 2) AND k % 14 <> 0"
    ),
    "ITT1": (
        "(SELECT p_partkey AS k, r_regionkey AS r FROM part JOIN region ON r_regionkey < 3) b"
        " WHERE NOT (k % 7 = 2 AND k % 3 = 0)"
    ),
}


def with_tables(names: tuple[str, ...], body: str, *more: str) -> str:
    """``body`` with the named tables, and further expressions, in front of it."""
    return "WITH " + ",\n".join([*(f"{name} AS ({_table(name)})" for name in names), *more]) + f"\n{body}"


def _table(name: str) -> str:
    columns = ", ".join(f"{text} AS {column}" for column, text in COLUMNS[name].items())
    return f"SELECT {'DISTINCT ' if name == 'ITM2' else ''}{columns} FROM {SOURCES[name]}"
