"""Near-duplicate documents by a Hamming join of b-bit MinHash signatures.

A signature has 64 slots of 16 bits. Two sets differ in a slot with probability 1 - J, so
sets with J >= 0.8 differ in more than 31 slots with a probability under one in ten million.
All pairs of signatures that differ in at most 31 slots are found and compared: the slots form 16 chunks
of 4, and by the pigeonhole principle 32 errors would be needed for two in every chunk, so
some chunk has at most one. Each chunk is indexed four times, each time without one of its
slots, which enumerates that error: 64 keys a document.

Documents that share a key are compared by signature, in blocks; close ones form families.
Within families the full shingle sets decide, again in blocks, and distributed union-find
turns the links into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.references import splittable
from .batches import parts
from .bits import BITS, bit_table, bits_of, passes
from .components import components
from .near import SET_BLOCK, SIGNATURE_BLOCK, close_links, in_block_pairs, per_block_pair, shared_keys, similar_links
from .scratch import settled
from .shingles import signature, word_shingles

SLOTS, CHUNK = 64, 4
GUARANTEED = 2 * (SLOTS // CHUNK) - 1
#: The slots, chunks and the guaranteed distance are made for this similarity and higher ones.
LEAST_PERCENT = 80


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Two texts are linked if their sets of distinct ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100, which is 80 or more: for less, signatures would lose links, so it is an
    error. ``component_id`` is the smallest doc_id reachable over links.
    A text with fewer words has one shingle, all of it; a null text or one without words has
    none, is linked with nothing and kept. Texts with equal sets are one class from the start.
    Rows that repeat a doc_id are judged each by its own text. Rows without doc_id belong to
    the class of their set and are kept only if that class has no doc_id, which is then null for all of it. ``doc_id`` may be
    of any type that can be ordered. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}, but signatures find all links from {LEAST_PERCENT} to 100 only")
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seen = settled(_signed(given, width), "signed")
    # The node of a set is a number of its own: one doc_id may stand for several texts. ``place`` is where its text is read again.
    place = F.struct("doc_id", "text_hash")
    sets = (
        seen.where("n_shingles > 0")
        .groupBy("fingerprint")
        .agg(
            F.min(F.when(F.col("doc_id").isNotNull(), place)).alias("named"),
            F.min("text_hash").alias("any"),
            F.first("signature").alias("signature"),
        )
        .select("fingerprint", F.col("named.doc_id").alias("first"), F.coalesce("named.text_hash", "any").alias("hash"), "signature")
    )
    sets = settled(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    linked = components(_links(given, sets, width, percent)).withColumnRenamed("node", "member")
    firsts = linked.join(splittable(sets.select("node", "first")), F.col("member") == F.col("node"))
    heads = firsts.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("head"))
    moved = linked.join(splittable(heads), F.col("component") == F.col("c")).select("member", "head")
    classes = sets.select(F.col("fingerprint").alias("own"), "node", "first").join(
        splittable(moved), F.col("node") == F.col("member"), "left"
    )
    classes = classes.select("own", F.coalesce("head", "first").alias("smallest"))
    placed = seen.join(splittable(classes), F.col("fingerprint") == F.col("own"), "left")
    component = F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return placed.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; none may be called ``__own`` or ``__own_hash``.

    Of a group the rows of one doc_id stay. Rows that repeat that doc_id with texts of equal sets are one document and stay together, and
    so do the rows of a group without any doc_id. Null texts and texts without words stay. An empty table gives no rows.
    """
    dropped = near_duplicates(docs, width, percent).where("NOT kept").select(
        F.col("doc_id").alias("__own"), F.col("text_hash").alias("__own_hash")
    )
    same = docs["doc_id"].eqNullSafe(F.col("__own")) & (F.xxhash64(docs["text"]) == F.col("__own_hash"))
    return docs.join(splittable(dropped.distinct()), same, "left_anti")


def _links(given: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    keys = F.array(*_key_columns())
    keyed = sets.select("node", F.posexplode(keys)).select(
        "node", F.xxhash64("pos", "col").alias("key")
    )
    met = shared_keys(keyed).select(F.col("node").alias("id"), "key", "members")
    met = met.join(splittable(sets.select("node", "signature")), F.col("id") == F.col("node")).drop("id")
    near_type = "a long, b long"
    near = per_block_pair(
        in_block_pairs(met, F.xxhash64("node", F.lit(1)), SIGNATURE_BLOCK), partial(close_links, threshold=GUARANTEED), near_type
    )
    families = components(near.distinct())
    sizes = families.groupBy("component").agg(F.count("*").alias("members"))
    member = families.join(splittable(sizes), "component").select(
        F.col("node").alias("id"), F.xxhash64("component").alias("key"), "members"
    )
    wanted = sets.select("node", "fingerprint", "first", "hash").join(member, F.col("node") == F.col("id")).drop("id")
    shared = _wanted_bits(wanted)
    named = _passing(given.where("doc_id IS NOT NULL"), shared).join(
        splittable(wanted), (F.col("doc_id") == F.col("first")) & (F.col("text_hash") == F.col("hash"))
    )
    # Of texts that no row with a doc_id has, one is enough; copies combine before the shuffle.
    nameless = _passing(given.where("doc_id IS NULL"), shared).groupBy("text_hash").agg(F.first("text").alias("text"))
    nameless = nameless.join(splittable(wanted.where("first IS NULL")), F.col("text_hash") == F.col("hash"))
    columns = ["text", "node", "fingerprint", "key", "members"]
    filled = _with_sets(named.select(columns).union(nameless.select(columns)), width)
    filled = filled.dropDuplicates(["node", "fingerprint"]).drop("fingerprint")
    return per_block_pair(
        in_block_pairs(filled, F.xxhash64("node", F.lit(1)), SET_BLOCK),
        partial(similar_links, threshold=GUARANTEED, percent=percent),
        near_type,
    )


def _place_number() -> Column:
    return F.xxhash64("doc_id", "text_hash").bitwiseAND(F.lit((1 << 56) - 1)).alias("number")


def _wanted_bits(wanted: DataFrame) -> Broadcast:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from bits_of(batch.column("number").to_numpy())

    places = wanted.select(F.col("first").alias("doc_id"), F.col("hash").alias("text_hash"))
    return bit_table(places.select(_place_number()).mapInArrow(run, BITS))


def _passing(given: DataFrame, shared: Broadcast) -> DataFrame:
    """The texts of the wanted documents, and of few others: the joins shuffle only these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(passes(shared.value, batch.column("number").to_numpy())))
            yield found.select(["doc_id", "text_hash", "text"])

    texts = given.select("doc_id", "text_hash", "text", _place_number())
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash long, text string")


def _key_columns() -> list:
    """For each chunk and each of its slots, the other slots of the chunk, as bytes."""
    columns = []
    for chunk in range(0, SLOTS, CHUNK):
        for left_out in range(CHUNK):
            parts = [F.substring("signature", 2 * k + 1, 2) for k in range(chunk, chunk + CHUNK) if k != chunk + left_out]
            columns.append(F.concat(*parts))
    return columns


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [word_shingles(text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, SLOTS).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "fingerprint", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, fingerprint binary, signature binary")


def _with_sets(texts: DataFrame, width: int) -> DataFrame:
    """The shingles of the rows whose set is the one wanted (a doc_id may have several texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [word_shingles(text, width) for text in batch.column("text").to_pylist()]
            wanted = batch.column("fingerprint").to_pylist()
            right = [k for k, s in enumerate(sets) if len(s) and fingerprint(s) == wanted[k]]
            kept = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *[kept.column(n) for n in ("node", "fingerprint", "key", "members")],
                    pa.array([signature(sets[k], SLOTS).tobytes() for k in right], pa.binary()),
                    pa.array([sets[k].view(np.int64) for k in right], pa.list_(pa.int64())),
                ],
                names=["node", "fingerprint", "key", "members", "signature", "shingles"],
            )

    return texts.mapInArrow(
        run, "node long, fingerprint binary, key long, members long, signature binary, shingles array<bigint>"
    )
