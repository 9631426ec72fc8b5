"""How the sources of a language differ in their terms, by three-dimensional cube partitioning.

Every language spans a cube: its sources in blocks along two axes, its kept terms in blocks along the
third. A task owns one cell, that is two blocks of sources and one of terms. The counts of a slice
(sources of a block, terms of a block) are replicated to the cells that need it, each cell
adds up what its terms contribute to the divergence of its pairs, and sums along the term axis
complete the pairs. So no task holds more than two blocks of sources with one block of terms, however many
sources or terms a language has, and no pair of sources ever meets row by row.

Terms that occur in none of a cell's sources differ by the same amount each, so only their number counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.references import splittable
from .batches import parts
from .scratch import settled

#: Documents of a language that a term needs, and ranks of terms that are reported.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Sources and terms of a block: a cell is compared on 2 x 64 x 4096 numbers.
GROUP_BLOCK, TERM_BLOCK = 64, 4096
#: Shares are whole numbers of this part.
UNIT = 1_000_000_000
#: Distinct terms that a task counts before it passes its counts on.
_HELD = 400_000
#: Non-letters below 0x80 become blanks, A-Z lower case; bytes of all other characters stay.
_LETTERS = bytes(k if k >= 0x80 or chr(k).isalpha() else 0x20 for k in range(256)).lower()


def source_divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` for every (lang, source) of ``docs`` (``text``, ``lang``, ``source``).

    A language keeps the terms (runs of ASCII letters and characters beyond ASCII, A-Z lower-cased) in at least
    ``least_docs`` of its rows. A term's share of a group is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's
    count of all kept terms and V their number; two shares differ by floor((p - q)^2 / (p + q)).
    Part ``pair``: the other sources of the language by the sum of these over all kept terms (0 without any).
    Part ``term``: the ``top`` kept terms that the source has with a greater share than its language. Ranks go by falling value,
    then by item.

    Null text, lang and source count as ''. Each row counts as a document, also if it repeats another. A source
    without terms is compared like any other; the only source of a language has no pairs. An empty table gives no rows.
    Other columns, whatever their names, are not read. All numbers are whole and exact as long as no language has
    more than 9 x 10^15 terms in its texts; beyond it the arithmetic raises an error.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = settled(_term_counts(given), "counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = settled(
        by_term.where(F.col("docs") >= least_docs).drop("docs").withColumn("term_id", F.monotonically_increasing_id()), "kept"
    )
    known = kept.select(F.col("lang").alias("l"), F.col("term").alias("t"), "term_id", "lang_n")
    matched = settled(
        counts.join(known, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("t"))).drop("l", "t", "docs"), "matched"
    )
    groups = settled(_groups(given, kept, matched), "groups")
    shares = matched.join(splittable(_keyed(groups)), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    shares = shares.withColumn("p", F.expr(_share("n", "total"))).select(
        "lang", "source", "group_id", "groups", "term", "term_id", "terms", "p", "lang_n", "lang_total"
    )
    return _pairs(groups, shares, group_block, term_block).unionByName(_terms(shares, top))


def _term_counts(given: DataFrame) -> DataFrame:
    """``n``, the places, and ``docs``, the rows, of every term in every group; tasks count before the shuffle."""
    rows = given.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        count_terms, "lang string, source string, term binary, n long, docs long"
    )
    rows = rows.withColumn("term", F.col("term").cast("string"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in parts(batches, 64):
        columns = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
        for lang, source, text in zip(*columns, strict=True):
            places, rows = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_LETTERS).split()
            size -= len(rows)
            places.update(words)
            rows.update(set(words))
            size += len(rows)
        if size > _HELD:
            yield from _batches(held)
            held, size = {}, 0
    yield from _batches(held)


def _batches(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (places, rows) in held.items():
        if rows:
            terms = list(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array([places[t] for t in terms], pa.int64()),
                    pa.array(list(rows.values()), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def _groups(given: DataFrame, kept: DataFrame, matched: DataFrame) -> DataFrame:
    """Every group with ``total`` (N + 2 V), ``lang_total``, ``terms`` (V) and ``groups``, the sources of its language."""
    found = given.select("lang", "source").distinct().withColumn("group_id", F.monotonically_increasing_id())
    own = matched.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("n"))
    languages = kept.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_n"))
    sizes = found.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("groups"))
    joined = (
        found.join(splittable(own), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
        .drop("l", "s")
        .join(splittable(languages), F.col("lang") == F.col("l"), "left")
        .drop("l")
        .join(splittable(sizes), F.col("lang") == F.col("l"))
        .drop("l")
    )
    none = F.lit(0).cast("long")
    return joined.select(
        "lang",
        "source",
        "group_id",
        "groups",
        F.coalesce("terms", none).alias("terms"),
        (F.coalesce("n", none) + 2 * F.coalesce("terms", none)).alias("total"),
        (F.coalesce("lang_n", none) + 2 * F.coalesce("terms", none)).alias("lang_total"),
    )


def _keyed(groups: DataFrame) -> DataFrame:
    return groups.withColumnsRenamed({"lang": "l", "source": "s"})


def _share(count: str, total: str) -> str:
    """1 + floor(10^9 (count + 2) / total) by long division in steps of 1000, so that whole 64-bit numbers are enough."""
    rest, share = f"({count} + 2) % {total}", f"({count} + 2) div {total}"
    for _ in range(3):
        share = f"({share}) * 1000 + (({rest}) * 1000) div {total}"
        rest = f"(({rest}) * 1000) % {total}"
    return f"1 + {share}"


def _pairs(groups: DataFrame, shares: DataFrame, group_block: int, term_block: int) -> DataFrame:
    def in_cells(rows: DataFrame) -> DataFrame:
        """The rows once for every cell along the other axis of sources."""
        blocks = F.ceil(F.col("groups") / group_block).cast("int")
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("group_id"), blocks).cast("int"))
        spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    term_blocks = F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)).cast("int")
    none = F.when(F.col("terms") > 0, F.expr(_share("0", "greatest(total, 1)"))).otherwise(F.lit(0).cast("long"))
    heads = in_cells(groups.withColumn("p", none)).withColumn("k", F.explode(F.sequence(F.lit(0), term_blocks - 1)))
    heads = heads.select("lang", "i", "j", "k", "block", "group_id", "terms", "p")
    slices = in_cells(shares.withColumn("k", F.pmod(F.xxhash64("term_id"), term_blocks).cast("int")))
    slices = slices.select("lang", "i", "j", "k", F.col("group_id").alias("member"), "term_id", F.col("p").alias("share"))
    cell = ["lang", "i", "j", "k"]
    partial = heads.groupBy(*cell).cogroup(slices.groupBy(*cell)).applyInArrow(cell_divergences, "a long, b long, part long")
    summed = partial.groupBy("a", "b").agg(F.sum("part").alias("value"))
    both = summed.select(F.explode(F.expr("array(struct(a AS own, b AS other), struct(b AS own, a AS other))")).alias("e"), "value")
    names = groups.select("group_id", "lang", "source")
    named = (
        both.select("e.own", "e.other", "value")
        .join(splittable(names), F.col("own") == F.col("group_id"))
        .drop("group_id")
        .join(splittable(names.select(F.col("group_id"), F.col("source").alias("item"))), F.col("other") == F.col("group_id"))
    )
    return _ranked(named, "pair")


def cell_divergences(key: tuple, heads: pa.Table, slices: pa.Table) -> pa.Table:
    """What one block of terms contributes to the divergence of the pairs between two blocks of sources.

    ``heads`` are the sources (``group_id``, ``block``, ``terms`` of the language, ``p`` of an absent term), ``slices`` each
    ``share`` of a term that occurs in a ``member``. Block 0 of the terms also counts what all terms would contribute if they were absent.
    """
    i, j, k = (x.as_py() for x in key[1:])
    ids, blocks, absent = (heads.column(c).to_numpy() for c in ("group_id", "block", "p"))
    order = np.argsort(ids)
    ids, blocks, absent = ids[order], blocks[order], absent[order].astype(np.int64)
    distinct, at = np.unique(slices.column("term_id").to_numpy(), return_inverse=True)
    shares = np.repeat(absent[:, None], len(distinct), axis=1)
    shares[np.searchsorted(ids, slices.column("member").to_numpy()), at] = slices.column("share").to_numpy()
    terms = heads.column("terms")[0].as_py()
    beyond = (terms if k == 0 else 0) - len(distinct)  # absent terms are counted in block 0, then taken off where they occur
    first, second = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    found = []
    for a in first:
        others = second if i != j else second[second > a]
        parts_of = differences(shares[a], shares[others]).sum(axis=1) + beyond * differences(absent[a], absent[others])
        found.append((np.full(len(others), ids[a]), ids[others], parts_of))
    columns = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else [(), (), ()])]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "part"])


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole shares up to 10^9 + 1; 0 where both are 0."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _terms(shares: DataFrame, top: int) -> DataFrame:
    with_language = shares.withColumn("q", F.expr(_share("lang_n", "lang_total"))).where("p > q")
    values = with_language.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return _ranked(values, "term").where(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
