from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal


def plain(value):
    if isinstance(value, Decimal):
        return value.normalize() + 0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[name]) for name in names) for row in df.collect())


def rows_of_duck(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    names = sorted(columns)
    order = [columns.index(name) for name in names]
    return names, Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
