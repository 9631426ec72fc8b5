"""Token ids as length-delimited binary records, with an index for reading in any order.

A shard is a data file and an index file. A record of the data file:

    length of the payload        unsigned 64 bits
    masked checksum of those     unsigned 32 bits
    payload: the ids             16 bits each if the vocabulary allows, else 32
    masked checksum of those     unsigned 32 bits

All numbers are little-endian. A checksum is the CRC-32, rotated right by 15 bits, plus a
constant, so that checksums of data that hold checksums stay sound. The index holds a fixed-size
entry for each record: doc_id, whether there is one, place in the data file, and number of ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import parts
from .files import make_folder, opened, written
from .scratch import new_folder, settled

INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("place", "<u8"), ("ids", "<u8")])
_LENGTH, _CHECK = struct.Struct("<Q"), struct.Struct("<I")
#: Pieces whose ids a worker remembers; then it starts anew.
REMEMBERED = 1 << 19
#: Characters that all versions of Unicode class alike, and among them letters and numbers.
PLAIN = re.compile("[\t\n\r\\x20-\\x7e\u00a1-\u00ac\u00ae-\u024f]*")
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: Fixed value: how byte-level BPE cuts a text before it merges, for texts of plain characters.
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
#: Fixed value: the letter that stands for a byte in byte-level BPE; printable ones stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER_OF_BYTE = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Characters of the texts that are encoded together.
_CHARS = 1 << 17


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _write_framed(out: BinaryIO, payload: bytes) -> None:
    length = _LENGTH.pack(len(payload))
    out.write(length + _CHECK.pack(masked_checksum(length)))
    out.write(payload)
    out.write(_CHECK.pack(masked_checksum(payload)))


def cuts_as_known(tokenizer: dict) -> bool:
    """Whether a tokenizer file (its JSON) cuts texts as ``PIECES`` does and merges the letters of their bytes only."""
    cutting, model = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    return (
        tokenizer.get("normalizer") is None
        and cutting.get("type") == "ByteLevel"
        and not cutting.get("add_prefix_space", True)
        and cutting.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    )


class _Encoder:
    """Ids of texts as bytes. A text of plain characters is cut into pieces, equal pieces are encoded once: merges
    never cross pieces. Other texts, those that hold an added token, and all texts if the file asks for another
    cutting, are encoded as they are."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_as_known(json.loads(self.tokenizer.to_str()))
        self.tokenizer.encode_special_tokens = not special
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        short = self.tokenizer.get_vocab_size() <= 1 << 16
        self.width, self.kind = ("<u2", "H") if short else ("<u4", "I")
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.width).tobytes() for x in found]

    def _merged(self, piece: str) -> bytes:
        """A piece's ids straight from the merges, which is what the library does with a piece."""
        letters = piece.encode().decode("latin-1").translate(LETTER_OF_BYTE)
        return array(self.kind, [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _plain(self, text: str) -> bool:
        return self.cuts and PLAIN.fullmatch(text) is not None and not any(token in text for token in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [PIECES.findall(text) if self._plain(text) else None for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for piece in set().union(*(p for p in cut if p is not None)).difference(self.known):
            self.known[piece] = self._merged(piece)
        whole = iter(self._encoded([text for text, p in zip(texts, cut, strict=True) if p is None]))
        return [next(whole) if p is None else b"".join(map(self.known.__getitem__, p)) for p in cut]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Places of consecutive texts with some _CHARS characters."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= _CHARS:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


@cache
def _encoder(path: str, special: bool) -> _Encoder:
    return _Encoder(path, special)


def write_records(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, special: bool = False
) -> DataFrame:
    """Writes every text of ``docs`` (``doc_id``, ``text``) in ascending doc_id order; returns the table of shards.

    ``tokenizer`` is the path of a file of the tokenizers library, the same on all machines. ``doc_id`` is a bigint.
    Where a text holds a special token's literal text, ``special`` gives it that token's id, as the library does by
    default; without it, the literal text is encoded like any other. Other added tokens of the file get their ids in both
    cases. Each document's ids end with ``end_id``. A null text is empty and so has that id only. Rows without
    doc_id come first; rows that repeat a doc_id follow each other in the order of a hash of their text. An
    empty table makes no shard. Other columns are not read.

    The shards (``shard``, ``data``, ``index``, ``records``, ``ids``) are ranges of doc_id, so ``shard`` orders them. The
    files go to ``folder``, by default a new one in the shared folder.
    """
    folder = folder or new_folder(docs.sparkSession, "token-records")
    make_folder(folder)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        filled = (batch for batch in batches if batch.num_rows)
        first = next(filled, None)
        if first is None:
            return
        encoder = _encoder(tokenizer, special)
        end = np.array([end_id], encoder.width).tobytes()
        data, index = f"{folder}/shard-{shard:06d}.data", f"{folder}/shard-{shard:06d}.index"
        records = ids = place = 0
        with written(data) as out, written(index) as entries:
            for batch in parts(_chain(first, filled), 1024):
                found = np.zeros(batch.num_rows, INDEX)
                ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for start, stop in _groups(texts):
                    for k, encoded in enumerate(encoder.encode(texts[start:stop]), start):
                        payload = encoded + end
                        _write_framed(out, payload)
                        n = len(payload) // len(end)
                        found[k] = (ids_of[k] or 0, ids_of[k] is not None, place, n)
                        place += 16 + len(payload)
                        ids += n
                entries.write(found.tobytes())
                records += batch.num_rows
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "data": [data], "index": [index], "records": [records], "ids": [ids], "width": [len(end)]}
        )

    shards = "shard long, data string, index string, records long, ids long, width long"
    return settled(ordered.select("doc_id", "text").mapInArrow(run, shards), "token-shards")


def _chain(first: pa.RecordBatch, others: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from others


def read_records(shards: DataFrame, seed: int | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` of every record.

    ``start`` counts the ids of all records before it; ``ids`` are little-endian unsigned 32-bit integers, left out
    without ``with_ids``, and ``ids_crc32`` is the CRC-32 of those bytes. Without a ``seed`` the records of a shard come in order;
    with one, in a random order of places looked up in the index. Lengths and checksums are verified;
    a damaged file is an error.
    """
    count = shards.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    placed = shards.select("shard", "data", "index", "width", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _records(row, seed, with_ids)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.repartition(max(1, count), "shard").mapInArrow(run, kind)


def _records(shard: dict, seed: int | None, with_ids: bool, rows: int = 256) -> Iterator[pa.RecordBatch]:
    with opened(shard["index"]) as source:
        index = np.frombuffer(source.read(), INDEX)
    starts = shard["first"] + np.concatenate(([0], np.cumsum(index["ids"].astype(np.int64))[:-1]))
    order = np.arange(len(index))
    if seed is not None:
        np.random.default_rng([seed, shard["shard"]]).shuffle(order)
    with opened(shard["data"]) as source:
        for at in range(0, len(order), rows):
            chosen = order[at : at + rows]
            ids = [_payload(source, index[k], shard) for k in chosen]
            columns = {
                "doc_id": pa.array([int(e["doc_id"]) if e["known"] else None for e in index[chosen]], pa.int64()),
                "start": pa.array(starts[chosen], pa.int64()),
                "n_tokens": pa.array(index["ids"][chosen].astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))


def _payload(source: BinaryIO, entry: np.void, shard: dict) -> bytes:
    place, width = int(entry["place"]), shard["width"]
    if source.tell() != place:
        source.seek(place)
    head = source.read(12)
    (length,), (check,) = _LENGTH.unpack(head[:8]), _CHECK.unpack(head[8:])
    if check != masked_checksum(head[:8]) or length != int(entry["ids"]) * width:
        raise ValueError(f"{shard['data']}: damaged length at {place}")
    payload = source.read(length)
    if _CHECK.unpack(source.read(4))[0] != masked_checksum(payload):
        raise ValueError(f"{shard['data']}: damaged record at {place}")
    return np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
