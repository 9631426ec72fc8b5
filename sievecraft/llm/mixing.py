"""Mixing sources to target weights.

The words of each source are packed into blocks of fixed length. The output is a row of
slots, cut into shards, and every slot of a shard draws its source, so that a shard's counts
are multinomial. The k-th slot of a source takes the block that the source's pseudorandom
permutation maps k to, and each further pass over the source has a permutation of its own. A permutation is a number of rounds
that each swap indices in random pairs or leave them (swap-or-not), so an index is mapped without any table.

Rows are placed by a hash of what they hold, never by where they were read, so the mix depends neither on how a
table is split nor on its order. Equal rows are one with a number of copies. Nothing is ranked over a whole source at once: documents are placed within hashed chunks of
a source, slots within their shard, and only the totals of chunks and shards are summed up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled
from .words import MERGED_PLACES, text_size

#: Words of a block, and slots of an output shard.
BLOCK, SHARD = 128, 65_536
#: Sources are a short list that weights are given for; more than this is an error.
MAX_SOURCES = 10_000
#: Documents of a chunk, within which they are placed one after the other.
CHUNK = 20_000
#: Rounds of a permutation, and copies of a row that are listed at a time.
SWAPS, COPIES = 24, 1000


class Source(NamedTuple):
    id: int
    source: str | None
    size: int
    blocks: int
    target: float
    quota: int


class Mixture(NamedTuple):
    """``sources``: id, source, size, blocks, target, quota. ``pieces``: identity, copy, doc_id, source_id, size, block, start, words
    (where a block's words come from; one piece without words for an empty text). ``slots``: shard, slot, source_id,
    block, epoch (which block each slot of the output holds)."""

    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """``share`` of all sizes, split by weight; what exceeds ``cap`` times a size is shared anew among the others."""
    found = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [k for k, size in enumerate(sizes) if size > 0]
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total > cap * sizes[k]]
        if not full:
            for k in open_:
                found[k] = left * weights[k] / total
            break
        for k in full:
            found[k] = float(cap * sizes[k])
        left -= sum(found[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return found


def mixture(
    rows: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 17,
) -> Mixture:
    """A mix of all ``rows`` of ``sized_rows`` (``identity`` and ``copy``, unique together; ``doc_id``, ``source``, ``size`` in words).

    Sources by code point, null last (a source of its own), weigh ``weights``, repeating. A source is taken
    ``target / size`` times, to the nearest block; no block more than ``cap`` times. Slots that drew a source
    beyond its quota go to those below theirs, so the totals are exact and reruns agree. Empty texts and
    tables take no slots.
    """
    spark = rows.sparkSession
    sources = _sources(rows, weights, share, cap, block)
    table = spark.createDataFrame(
        sources, "id int, source string, size bigint, blocks bigint, target double, quota bigint"
    )
    # Bounded by MAX_SOURCES rows.
    names = F.broadcast(table.select(F.col("id").alias("source_id"), F.col("source").alias("own")))
    known = rows.join(names, F.col("source").eqNullSafe(F.col("own"))).select("identity", "copy", "doc_id", "source_id", "size")
    return Mixture(table, _pieces(known, block), _slots(spark, sources, shard, seed))


def _sources(rows: DataFrame, weights: Sequence[float], share: float, cap: int, block: int) -> list[Source]:
    grouped = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(grouped) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    ordered = sorted(((row["source"], row["size"]) for row in grouped), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [size for _, size in ordered]
    wanted = targets(sizes, [float(weights[k % len(weights)]) for k in range(len(sizes))], share, cap)
    found = []
    for k, (source, size) in enumerate(ordered):
        blocks = -(-size // block)
        quota = min(round(blocks * wanted[k] / size), cap * blocks) if size else 0
        found.append(Source(k, source, size, blocks, wanted[k], quota))
    return found


def _pieces(known: DataFrame, block: int) -> DataFrame:
    chunks = max(1, math.ceil(known.count() / CHUNK))
    dealt = known.withColumn("chunk", F.pmod(F.xxhash64("identity", "copy"), F.lit(chunks)))
    totals = dealt.groupBy(F.col("source_id").alias("s"), F.col("chunk").alias("c")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_id", "chunk").orderBy("identity", "copy", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, (F.col("source_id") == F.col("s")) & (F.col("chunk") == F.col("c")))
    first = F.col("within") + F.col("offset")
    placed = placed.select("identity", "copy", "doc_id", "source_id", "size", first.alias("first"), (first + F.col("size")).alias("end"))
    covered = F.when(
        F.col("size") > 0, F.sequence(F.expr(f"first DIV {block}"), F.expr(f"(end - 1) DIV {block}"))
    )
    spread = placed.withColumn("block", F.explode_outer(covered))
    start = F.greatest("first", F.col("block") * block)
    stop = F.least("end", (F.col("block") + 1) * block)
    return spread.select(
        "identity", "copy", "doc_id", "source_id", "size", "block", (start - F.col("first")).alias("start"), (stop - start).alias("words")
    )


def _unit(*parts: Column) -> Column:
    """A pseudorandom number from 0 to 1."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def _values(values: Sequence, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def _alias_table(shares: Sequence[float]) -> tuple[list[float], list[int]]:
    """For drawing an index by its share in one step: keep index k below a threshold, else take its alias."""
    scaled = [s * len(shares) for s in shares]
    keep, alias = [1.0] * len(shares), list(range(len(shares)))
    small = [k for k, s in enumerate(scaled) if s < 1]
    large = [k for k, s in enumerate(scaled) if s >= 1]
    while small and large:
        low, high = small.pop(), large.pop()
        keep[low], alias[low] = scaled[low], high
        scaled[high] -= 1 - scaled[low]
        (small if scaled[high] < 1 else large).append(high)
    return keep, alias


def _slots(spark, sources: list[Source], shard: int, seed: int) -> DataFrame:
    total = sum(s.quota for s in sources)
    if not total:
        return spark.createDataFrame([], "shard bigint, slot bigint, source_id int, block bigint, epoch bigint")
    keep, alias = _alias_table([s.quota / total for s in sources])
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id DIV {shard}").alias("shard"))
    column = F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(len(sources))).cast("int")
    stays = _unit(F.lit(seed + 1), "slot") < F.get(_values(keep, "double"), column)
    drawn = slots.withColumn("source_id", F.when(stays, column).otherwise(F.get(_values(alias, "int"), column)))

    counts = drawn.groupBy("shard", "source_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("h"), F.col("source_id").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "source_id").orderBy("slot")) - 1
    ranked = drawn.withColumn("within", rank).join(
        offsets, (F.col("shard") == F.col("h")) & (F.col("source_id") == F.col("s"))
    )
    ranked = ranked.select("shard", "slot", "source_id", (F.col("within") + F.col("offset")).alias("k"))

    drawn_totals = {row["source_id"]: row["n"] for row in counts.groupBy("source_id").agg(F.sum("n").alias("n")).collect()}
    took = [drawn_totals.get(s.id, 0) for s in sources]
    surplus, deficit = [0], [0]
    for s, n in zip(sources, took, strict=True):
        surplus.append(surplus[-1] + max(0, n - s.quota))
        deficit.append(deficit[-1] + max(0, s.quota - n))
    source, k = F.col("source_id"), F.col("k")
    quota = F.get(_values([s.quota for s in sources], "bigint"), source)
    spare = F.get(_values(surplus, "bigint"), source) + k - quota
    moved = ranked.withColumn("spare", F.when(k >= quota, spare))
    taker = F.size(F.filter(_values(deficit[1:], "bigint"), lambda d: d <= F.col("spare")))
    moved = moved.withColumn("source_id", F.when(F.col("spare").isNull(), source).otherwise(taker))
    index = F.when(F.col("spare").isNull(), k).otherwise(
        F.get(_values(took, "bigint"), source) + F.col("spare") - F.get(_values(deficit, "bigint"), source)
    )
    moved = moved.select("shard", "slot", "source_id", index.alias("k"))

    blocks = F.get(_values([s.blocks for s in sources], "bigint"), source)
    epochs = moved.withColumn("blocks", blocks).withColumn("epoch", F.expr("k DIV blocks"))
    place = _permuted(F.expr("k % blocks"), F.col("blocks"), F.lit(f"{seed}"), source, F.col("epoch"))
    return epochs.select("shard", "slot", "source_id", place.alias("block"), "epoch")


def _permuted(index: Column, n: Column, *key: Column) -> Column:
    """Where the permutation of 0 .. n - 1 that ``key`` names takes ``index``.

    In each round a random number pairs every index x with (number - x) mod n, and a random bit of the pair, the
    same seen from either side, tells whether its two places are swapped.
    """

    def swapped(x: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), turn, *key), n) - x, n)
        bit = F.xxhash64(F.lit("swap"), turn, F.greatest(x, other), *key).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), index.cast("bigint"), swapped)


def sized_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``identity`` (hash of the row), ``copy`` (from 0), ``doc_id``, ``source`` and ``size`` of every row of ``docs``, as a stored table.

    ``docs`` holds ``doc_id``, ``source`` and ``text``; rows that also agree in the further ``columns`` are copies of each other.
    """
    identity = _identity("doc_id", "source", "text", *columns)
    sized = docs.select(identity.alias("identity"), "doc_id", "source", text_size(F.col("text")).alias("size"))
    counted = sized.groupBy("identity", "doc_id", "source", "size").agg(F.count("*").alias("copies"))
    # In two steps, so that no array grows with the number of copies.
    blocks = counted.withColumn("of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) DIV {COPIES}"))))
    inside = F.sequence(F.col("of") * COPIES, F.least(F.col("copies"), (F.col("of") + 1) * COPIES) - 1)
    return settled(blocks.select("identity", F.explode(inside).alias("copy"), "doc_id", "source", "size"), "sizes")


def _identity(*columns: str) -> Column:
    """A hash of a row that does not take a null for an absent column."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def taken_words(mix: Mixture) -> DataFrame:
    """``doc_id``, ``source_id``, ``size`` and ``taken`` for every row: the words that the slots hold of it, repeats counted.

    A row of a null or empty text has size and taken 0; equal rows have a result each; an empty table gives none.
    """
    times = mix.slots.groupBy(F.col("source_id").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"))
    drawn = mix.pieces.join(times, (F.col("source_id") == F.col("s")) & (F.col("block") == F.col("b")), "left")
    words = F.coalesce(F.col("words") * F.col("times"), F.lit(0))
    return drawn.groupBy("identity", "copy", "doc_id", "source_id", "size").agg(F.sum(words).alias("taken")).drop("identity", "copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: for each pass over its source, a row with what was taken of a text.

    A text taken whole stays as it is; of others the taken words follow each other, one space apart.
    ``n_chars``, if there is such a column, is the new length. Documents without a taken word go, and so do null and
    empty texts. Rows that are equal in all columns are mixed each on its own, and give equal rows where the same words of them
    were taken. A table without a word gives no rows. Names of temporary columns begin with two underscores; ``docs`` must not have such.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    numbered = settled(numbered.withColumn("__identity", _identity("doc_id", "source", "text", *others)), "numbered")
    mix = mixture(sized_rows(numbered, *others), **options)
    slots = mix.slots.select(F.col("source_id").alias("s"), F.col("block").alias("b"), "epoch")
    places = mix.pieces.join(slots, (F.col("source_id") == F.col("s")) & (F.col("block") == F.col("b")))
    place = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("words")).cast("int").alias("stop"))
    parts = places.groupBy("identity", "copy", "epoch", F.col("size").alias("__size")).agg(
        F.sum("words").alias("__words"), F.sort_array(F.collect_list(place)).alias("places")
    )
    parts = parts.select("identity", "__size", "__words", F.expr(MERGED_PLACES).alias("__places"))
    # One of equal rows gives the text of all.
    first = numbered.groupBy(F.col("__identity").alias("own")).agg(F.min("__row").alias("__of"))
    parts = parts.join(first, F.col("identity") == F.col("own")).drop("own", "identity")
    joined = numbered.join(parts, F.col("__row") == F.col("__of"))
    some = F.expr(
        r"array_join(flatten(transform(__places, p -> slice(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), "
        r"p.start + 1, p.stop - p.start))), ' ')"
    )
    mixed = joined.withColumn("text", F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(docs.columns)
