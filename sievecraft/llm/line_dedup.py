"""Fuzzy line deduplication by MinHash.

A line's set are its character shingles. Its signature has 60 slots of 8 bits, from one hash for
each shingle that also picks the slot; slots that stay empty borrow from others (optimal
densification). Twelve bands of five slots are the keys: lines with a Jaccard similarity
of 0.8 meet in some band with a probability of 0.99, those with 0.9 practically always.

Equal lines are one class from the start. Lines that share a band are compared by signature, in
blocks; within the families that arise, full shingle sets decide. Distributed union-find
makes components, and of each component the first line stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.references import splittable
from .batches import parts
from .bits import BITS, bit_table, bits_of, passes
from .components import components
from .near import SET_BLOCK, SIGNATURE_BLOCK, close_links, in_block_pairs, per_block_pair, shared_keys, similar_links
from .scratch import settled
from .shingles import MULTIPLIER, character_shingles, mixed, windows

SHINGLE, SLOTS, ROWS = 8, 60, 5
#: Signatures of lines with a similarity of 0.8 differ in more slots with a probability under one in a thousand.
THRESHOLD = 22
#: Bands and cut are made for this similarity and higher ones.
LEAST_PERCENT = 80
#: Characters whose lines are hashed at a time, and keys that a task sorts at a time.
_CHARS, _KEYS = 1 << 18, 1 << 22


def normal(line: str) -> str:
    return line.strip().lower()


def fingerprint(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _rolling(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every run of SHINGLE = 8 items."""
    factor = 0x9E3779B1
    for step in (1, 2, 4):
        if len(points) <= step:
            return np.empty(0, np.uint32)
        points = points[:-step] * np.uint32(factor) + points[step:]
        factor = factor * factor & 0xFFFFFFFF
    points = (points ^ (points >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    points = (points ^ (points >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return points ^ (points >> np.uint32(16))


@cache
def _borrowed() -> np.ndarray:
    """For each attempt, where each slot looks."""
    return np.random.default_rng(3).integers(0, SLOTS, (64, SLOTS))


def signatures(lines: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each line; every line has a character."""
    padded = [line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines]
    sizes = np.array([len(line) for line in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = _rolling(points * np.uint32(0x27D4EB2F) + np.uint32(1))
    # Shingles start everywhere but in the last seven places of a line.
    line = np.repeat(np.arange(len(lines)), sizes)[: len(hashes)]
    inside = line == np.repeat(np.arange(len(lines)), sizes)[SHINGLE - 1 :]
    line, hashes = line[inside], hashes[inside]
    none = np.uint32(0xFFFFFFFF)
    least = np.full(len(lines) * SLOTS, none)
    np.minimum.at(least, line * SLOTS + (hashes % np.uint32(SLOTS)).astype(np.int64), hashes // np.uint32(SLOTS))
    least = least.reshape(-1, SLOTS)
    filled = least != none
    row, slot = np.nonzero(~filled)
    for places in _borrowed():
        if not len(row):
            break
        source = places[slot]
        found = filled[row, source]
        least[row[found], slot[found]] = least[row[found], source[found]]
        row, slot = row[~found], slot[~found]
    least[row, slot] = least[row, filled[row].argmax(axis=1)]
    spread = least * np.uint32(0x9E3779B1)
    return (spread >> np.uint32(24)).astype(np.uint8)


def line_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id``, ``line`` (from 0), ``first_doc_id``, ``first_line`` and ``kept`` for every line of ``docs`` (``doc_id``, ``text``).

    Lines end at line feeds and are compared without white space around them, in lower case, by their distinct 8-character
    shingles (a shorter line is one shingle). Lines with a similarity of at least ``percent`` / 100 (80 or more; less is an
    error, since bands and cut would lose most links) are linked; the
    line that is first by doc_id and place in its component stays (``first_doc_id``, ``first_line``). Blank lines,
    and so empty and null texts, are kept as they are and have no first line. Rows without doc_id come first.
    Rows that repeat a doc_id have lines of the same names; the first of such lines is kept in each. ``doc_id`` may be of any
    type that can be ordered. An empty table gives no rows. Other columns are not read.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}, but bands and cut are made for {LEAST_PERCENT} to 100")
    # ``number`` stands for the doc_id of any type.
    given = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("number"))
    kind = given.schema["doc_id"].dataType.simpleString()
    place = F.struct(F.col("doc_id"), F.col("line"))
    # Lines are cut, folded and hashed once; a batch signs equal ones once.
    placed = settled(given.mapInArrow(_placed_lines, f"doc_id {kind}, number long, line int, print binary, signature binary"), "placed")
    distinct = (
        placed.where("signature IS NOT NULL")
        .groupBy("print")
        .agg(F.min(F.struct(F.col("doc_id"), F.col("line"), F.col("number"))).alias("first"), F.first("signature").alias("signature"))
    )
    distinct = distinct.select("print", F.struct("first.doc_id", "first.line").alias("first"), F.col("first.number").alias("number"), "signature")
    classes = settled(distinct.withColumn("node", F.monotonically_increasing_id()), "lines")
    linked = _components(given, classes, percent)
    firsts = linked.join(splittable(classes.select(F.col("node").alias("own"), "first", "print")), F.col("node") == F.col("own"))
    heads = firsts.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("head"))
    moved = firsts.join(splittable(heads), F.col("component") == F.col("c")).select(F.col("print").alias("moved"), "head")
    known = classes.select(F.col("print").alias("own"), "first").join(splittable(moved), F.col("own") == F.col("moved"), "left")
    known = known.select("own", F.coalesce("head", "first").alias("head"))

    judged = placed.select("doc_id", "line", "print").join(splittable(known), F.col("print") == F.col("own"), "left")
    head = F.when(F.col("print").isNotNull(), F.col("head"))
    return judged.select(
        "doc_id",
        "line",
        head["doc_id"].alias("first_doc_id"),
        head["line"].alias("first_line"),
        (F.col("print").isNull() | place.eqNullSafe(head)).alias("kept"),
    )


def deduplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the lines that ``line_classes`` does not keep; all columns stay, and so do texts without such lines.

    A null text stays null, and one that loses all its lines is empty. Rows that repeat a doc_id lose the same lines. An empty
    table stays empty. ``docs`` must not have columns ``__own`` or ``__dropped``.
    """
    dropped = line_classes(docs, percent).where("NOT kept").groupBy(F.col("doc_id").alias("__own"))
    lists = dropped.agg(F.collect_set("line").alias("__dropped"))
    joined = docs.join(splittable(lists), docs["doc_id"].eqNullSafe(F.col("__own")), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("__dropped", at))
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(docs.columns)


def _components(given: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    keyed = _keyed(classes, _repeated(classes))
    met = shared_keys(keyed).select(F.col("node").alias("id"), "key", "members")
    met = met.join(splittable(classes.select("node", "signature")), F.col("id") == F.col("node")).drop("id")
    near = per_block_pair(
        in_block_pairs(met, F.xxhash64("node", F.lit(1)), SIGNATURE_BLOCK),
        partial(close_links, threshold=THRESHOLD, bits=8),
        "a long, b long",
    )
    families = components(near.distinct())
    sizes = families.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("members"))
    member = families.join(splittable(sizes), F.col("component") == F.col("c")).select(
        F.col("node").alias("id"), F.xxhash64("component").alias("key"), "members"
    )
    known = classes.select("node", "print", "number", F.col("first.line").alias("line"))
    wanted = settled(member.join(splittable(known), F.col("id") == F.col("node")).drop("id"), "families")
    texts = given.mapInArrow(partial(_wanted_lines, shared=_wanted_bits(wanted)), "found binary, text string").dropDuplicates(["found"])
    wanted = wanted.drop("number", "line")
    matched = texts.join(splittable(wanted), F.col("found") == F.col("print")).select("node", "key", "members", "text")
    return components(
        per_block_pair(
            in_block_pairs(matched, F.xxhash64("node", F.lit(1)), SET_BLOCK),
            partial(_similar_texts, percent=percent),
            "a long, b long",
        )
    )


def _similar_texts(table: pa.Table, starts: np.ndarray, percent: int) -> pa.Table:
    """``similar_links`` of rows that hold a ``text``: it is shorter than its set, so that is made here."""
    texts = table.column("text").to_pylist()
    sets = [s.view(np.int64) for s in _shingle_sets(texts)]
    table = table.append_column("signature", pa.array([r.tobytes() for r in signatures(texts)], pa.binary()))
    table = table.append_column("shingles", pa.array(sets, pa.list_(pa.int64())))
    return similar_links(table, starts, THRESHOLD, percent, bits=8)


def _shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line; many lines are hashed at once."""
    sets, start = [], 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (size < _CHARS or stop == start):
            size += len(lines[stop])
            stop += 1
        points = np.frombuffer("".join(lines[start:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = windows(mixed(points.astype(np.uint64) + np.uint64(1)), SHINGLE)
        at = 0
        for line in lines[start:stop]:
            own = hashes[at : at + len(line) - SHINGLE + 1]
            sets.append(np.unique(own) if len(line) >= SHINGLE else character_shingles(line, SHINGLE))
            at += len(line)
        start = stop
    return sets


def band_keys(rows: list[bytes]) -> np.ndarray:
    """A key for each band (column) of each signature (row)."""
    slots = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), SLOTS // ROWS, ROWS).astype(np.uint64)
    packed = np.broadcast_to(np.arange(SLOTS // ROWS, dtype=np.uint64), slots.shape[:2]).copy()
    for k in range(ROWS):
        packed = (packed << np.uint64(8)) | slots[:, :, k]
    return mixed(packed)


def _short_keys(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Short forms of all keys, sorted, a row for each range that has any; many batches are one."""
    held, size = [], 0
    for batch in batches:
        held.append((band_keys(batch.column("signature").to_pylist()).ravel() >> np.uint64(32)).astype(np.uint32))
        size += len(held[-1])
        if size >= _KEYS:
            yield _in_ranges(held, ranges)
            held, size = [], 0
    if size:
        yield _in_ranges(held, ranges)


def _in_ranges(held: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    short = np.sort(np.concatenate(held))
    borders = np.searchsorted(short, (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
    cut = np.split(short, borders)
    filled = [k for k, part in enumerate(cut) if len(part)]
    columns = [pa.array(filled, pa.int64()), pa.array([cut[k].tobytes() for k in filled], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "short"])


def _repeated(classes: DataFrame) -> Broadcast:
    """A table of bits for the keys that occur more than once; short forms of the keys are sorted to find them."""
    ranges = max(256, -(-classes.count() // 100_000))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = np.sort(np.frombuffer(b"".join(p for batch in batches for p in batch.column("short").to_pylist()), np.uint32))
        often = np.unique(short[1:][short[1:] == short[:-1]])
        yield from bits_of(often.astype(np.int64))

    rows = classes.select("signature").mapInArrow(partial(_short_keys, ranges=ranges), "range long, short binary")
    return bit_table(rows.repartition("range").mapInArrow(repeated, BITS))


def _keyed(classes: DataFrame, shared: Broadcast) -> DataFrame:
    """``node`` and ``key`` for the keys that pass the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            keys = band_keys(batch.column("signature").to_pylist())
            row, band = np.nonzero(passes(table, (keys >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(row)), pa.array(keys[row, band].view(np.int64))], ["node", "key"]
            )

    return classes.select("node", "signature").mapInArrow(run, "node long, key long")


def _line_numbers(numbers: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A number for each place (number of the doc_id, line)."""
    both = numbers.view(np.uint64) * MULTIPLIER + lines.astype(np.uint64)
    return (mixed(both) >> np.uint64(8)).astype(np.int64)


def _wanted_bits(wanted: DataFrame) -> Broadcast:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from bits_of(_line_numbers(batch.column("number").to_numpy(), batch.column("line").to_numpy()))

    return bit_table(wanted.select("number", "line").mapInArrow(run, BITS))


def _placed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line's place and print, none if it is blank; of equal lines of a batch the first by place has the signature."""

    def lines(batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "number", "text")]
        for doc_id, number, text in zip(*columns, strict=True):
            for at, line in enumerate(lines_of(text)):
                yield doc_id, number, at, normal(line)

    kind = None
    part, size = [], 0
    for batch in parts(batches):
        kind = batch.schema.field("doc_id").type
        for line in lines(batch):
            part.append(line)
            size += len(line[3])
            if size >= _CHARS or len(part) >= _CHARS:
                yield _placed_batch(part, kind)
                part, size = [], 0
    if part:
        yield _placed_batch(part, kind)


def _placed_batch(part: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    prints = [fingerprint(line) if line else None for *_, line in part]
    first: dict[bytes, int] = {}
    for k, known in enumerate(prints):
        if known is not None and (known not in first or _order(part[k]) < _order(part[first[known]])):
            first[known] = k
    signed: list[bytes | None] = [None] * len(part)
    if first:
        for k, row in zip(first.values(), signatures([part[k][3] for k in first.values()]), strict=True):
            signed[k] = row.tobytes()
    doc_ids, numbers, places, _ = zip(*part, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, kind),
            pa.array(numbers, pa.int64()),
            pa.array(places, pa.int32()),
            pa.array(prints, pa.binary()),
            pa.array(signed, pa.binary()),
        ],
        names=["doc_id", "number", "line", "print", "signature"],
    )


def _order(line: tuple) -> tuple:
    doc_id, _, at, _ = line
    return doc_id is not None, 0 if doc_id is None else doc_id, at


def _wanted_lines(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Lines at the wanted places, and few others."""
    for batch in parts(batches):
        found: dict[bytes, str] = {}
        numbers = batch.column("number").to_numpy()
        for k, text in enumerate(batch.column("text").to_pylist()):
            lines = lines_of(text)
            own = _line_numbers(np.repeat(numbers[k : k + 1], len(lines)), np.arange(len(lines)))
            for at in np.flatnonzero(passes(shared.value, own)):
                if line := normal(lines[at]):
                    found[fingerprint(line)] = line
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], names=["found", "text"]
        )
