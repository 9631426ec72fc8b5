"""Running many checks at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf
from ..operators import Family, key_counts
from .rule import KEYED, RULES, SHARED, WIDER, KeyRule, RowRule, Rule, Source, TableMap

#: Equal findings that one row is repeated to at a time.
REPEATS = 1000


def findings(
    tables: TableMap, as_of: AsOf = None, rule_ids: Iterable[str] | None = None, details: bool = True
) -> DataFrame:
    """One row per finding: rule_id, category, record_key and, as JSON, details.

    Checks that look at the same rows share one pass over them, with marks for what other tables say about their keys;
    checks that count keys share one count (``plans/shared.py``). A check that has nothing to share with the others chosen
    runs its own plan, unsorted. ``details=False`` leaves the JSON out.
    """
    chosen = list(RULES.values()) if rule_ids is None else [RULES[rule_id] for rule_id in rule_ids]
    if not chosen:
        raise ValueError("no rules chosen")
    passes, counts, alone = _shares(chosen)
    parts = [_one_pass(source, rules, tables, as_of, details) for source, rules in passes]
    if counts:
        parts.append(_one_count(counts, tables, details))
    for found in alone:
        rows = found.run(tables, as_of, ordered=False)
        key = [F.col(name) for name in found.key]
        parts.append(rows.select(*_finding(found, key, rows.columns if details else None)))
    return _union(parts)


def _shares(chosen: list[Rule]) -> tuple[list[tuple[Source, list[RowRule]]], list[KeyRule], list[Rule]]:
    """Sources with the checks that share a pass over them, checks that share a count, and the others."""
    forms = {found.rule_id: found if isinstance(found, RowRule) else SHARED.get(found.rule_id) for found in chosen}
    asked = {SHARED[rule_id].source.name for rule_id in forms if rule_id in SHARED}
    by_source: dict[str, tuple[Source, list[RowRule]]] = {}
    for found in filter(None, forms.values()):
        source = found.source
        if source.name in WIDER and WIDER[source.name][0].name in asked:
            source = WIDER[source.name][0]
        by_source.setdefault(source.name, (source, []))[1].append(found)
    passes = [(s, rules) for s, rules in by_source.values() if len(rules) > 1 or rules[0].rule_id not in SHARED]
    counts = [KEYED[found.rule_id] for found in chosen if found.rule_id in KEYED]
    counts = counts if len(counts) > 1 else []
    done = {found.rule_id for _, rules in passes for found in rules} | {found.rule.rule_id for found in counts}
    return passes, counts, [found for found in chosen if found.rule_id not in done]


def summary(found: DataFrame) -> DataFrame:
    """Number of findings per rule; rules without findings have no row."""
    return found.groupBy("rule_id", "category").agg(F.count("*").alias("findings"))


def _union(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts. Joined in halves: each union checks its whole plan
    again, which a chain would do once per part."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return _union(parts[:half]).unionAll(_union(parts[half:]))


def _finding(found: Rule, key: list[Column], shown: list[Column | str] | None) -> list[Column]:
    """The columns of a finding, given the key and, if wanted, the shown columns."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in key]
    finding = [
        F.lit(found.rule_id).alias("rule_id"),
        F.lit(found.category).alias("category"),
        F.concat_ws("|", *texts).alias("record_key"),
    ]
    if shown is not None:
        finding.append(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("details"))
    return finding


def _one_pass(source: Source, rules: list[RowRule], tables: TableMap, as_of: AsOf, details: bool) -> DataFrame:
    """Findings of rules that look at the rows of ``source``. Rows that break none are filtered out
    first, since Spark can move parts of that condition below the source's joins."""
    counted = any(found.distinct is not None or found.times for found in rules)
    conditions = [_where(found, source, as_of) for found in rules]
    hits = []
    for found, holds in zip(rules, conditions):
        finding = _finding(found, found.key_columns(as_of), found.columns(as_of) if details else None)
        if counted:
            finding += _count_columns(found, as_of)
        hits.append(F.when(holds, F.struct(*finding)))
    rows = source.rows(tables).filter(reduce(or_, conditions))
    rows = rows.select(F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("hit.*")
    return _repeated(rows) if counted else rows


def _where(found: RowRule, source: Source, as_of: AsOf) -> Column:
    holds = found.where(as_of)
    return holds if found.source.name == source.name else holds & WIDER[found.source.name][1]()


def _count_columns(found: RowRule, as_of: AsOf) -> list[Column]:
    """What decides how often a finding counts: ``identity`` (NULL unless equal rows count once) and ``times``."""
    identity = F.lit(None).cast("string")
    if found.distinct is not None:
        identity = F.to_json(F.struct(*found.columns(as_of), *(F.col(c).alias(f"__{c}") for c in found.distinct)), {"ignoreNullFields": "false"})
    times = F.lit(1).cast("bigint") if found.times is None else found.times(as_of).cast("bigint")
    return [identity.alias("__identity"), times.alias("__times")]


def _repeated(rows: DataFrame) -> DataFrame:
    """Findings as often as they count. Equal ones are added up before the shuffle."""
    names = [name for name in rows.columns if name != "__times"]
    summed = rows.groupBy(*names).agg(F.sum("__times").alias("times"))
    summed = summed.withColumn("times", F.when(F.col("__identity").isNull(), F.col("times")).otherwise(1))
    # In two steps, so that no array grows with the number of equal findings.
    blocks = summed.withColumn("block", F.explode(F.sequence(F.lit(1), F.ceil(F.col("times") / REPEATS))))
    size = F.least(F.lit(REPEATS), F.col("times") - (F.col("block") - 1) * REPEATS).cast("int")
    kept = [name for name in names if name != "__identity"]
    return blocks.select(*kept, F.explode(F.array_repeat(F.lit(1), size)).alias("one")).drop("one")


def _one_count(counts: list[KeyRule], tables: TableMap, details: bool) -> DataFrame:
    """Findings of rules that count keys, from one aggregate over one scan of each table."""
    families: dict[str, list[Family]] = {}
    for found in counts:
        where = None if found.where is None else found.where()
        families.setdefault(found.table, []).append(Family(found.rule.rule_id, [key() for key in found.keys.values()], where))
    counted = key_counts(*((tables[table], own) for table, own in families.items()))
    often = reduce(or_, [(F.col("family") == c.rule.rule_id) & (F.col("rows") >= c.least) for c in counts])
    columns = [
        F.col("family").alias("rule_id"),
        _by_rule(counts, lambda found: F.lit(found.rule.category)).alias("category"),
        _by_rule(counts, _record_key).alias("record_key"),
    ]
    if details:
        columns.append(_by_rule(counts, lambda found: _details(found, tables[found.table])).alias("details"))
    return counted.filter(often).select(*columns)


def _by_rule(counts: list[KeyRule], text: Callable[[KeyRule], Column]) -> Column:
    return F.coalesce(*(F.when(F.col("family") == found.rule.rule_id, text(found)) for found in counts))


def _record_key(found: KeyRule) -> Column:
    at = list(found.keys)
    return F.concat_ws("|", *(F.coalesce(F.get("key", F.lit(at.index(name))), F.lit("")) for name in found.rule.key))


def _details(found: KeyRule, df: DataFrame) -> Column:
    """The shown columns as JSON, key parts in their own types."""
    types = df.select(*(key().alias(name) for name, key in found.keys.items())).schema
    shown = [F.get("key", F.lit(k)).cast(field.dataType).alias(field.name) for k, field in enumerate(types)]
    if found.count:
        shown.append(F.col("rows").alias(found.count))
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
