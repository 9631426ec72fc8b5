"""Web archives of individually compressed records that share a dictionary.

A file begins with a skippable frame that holds its Zstandard dictionary, itself compressed;
each record is a frame of its own behind it. A payload that occurs more than once is stored
once, as a response; the other records refer to it and keep its digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.references import splittable
from .files import make_folder, opened, written
from .sampling import thinned
from .scratch import new_folder, settled

#: Fixed value: the magic number of the frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
_FRAME = struct.Struct("<II")
#: Records, bytes of each, that the dictionary is built from, and its size.
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 8192, 64 * 1024
#: A file is ended after so many bytes.
FILE_BYTES = 1 << 30
_CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(
    pages: DataFrame, folder: str | None = None, smallest: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3
) -> DataFrame:
    """Writes a record for every row of ``pages`` (``page_id``, ``url``, ``html``); returns the table of files.

    Of records with equal payloads of at least ``smallest`` bytes, that with the largest page_id is a response
    (each of them, if rows repeat it, and all of them, if none has an id) and the others are revisits of it.
    A null html is an empty payload, a null url an empty address. Control characters of an address are
    percent-encoded. An empty table makes no file. Other columns are not read.

    The files (``file``, ``records``) go to ``folder``, by default a new one in the shared folder. All hold the same
    dictionary, built from a sample of SAMPLES records; if they are too few for one, the files have none.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    make_folder(folder)
    given = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    dictionary = _dictionary(given, date)
    large = F.octet_length("html") >= smallest
    last = (
        given.where(large).groupBy(F.col("digest").alias("own")).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    )
    repeated = last.where("n > 1 AND last IS NOT NULL").select("own", "last")
    judged = given.join(splittable(repeated), (F.col("digest") == F.col("own")) & large, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_loaded(dictionary), write_checksum=True)
        rows = ((compressor.compress(record_of(row, date))) for batch in batches for row in batch.to_pylist())
        part, done = 0, False
        while not done:
            first = next(rows, None)
            if first is None:
                return
            name, records, size, done = f"{folder}/part-{task:06d}-{part:04d}.warc.zst", 0, 0, True
            with written(name) as out:
                out.write(dictionary_frame(dictionary))
                frame = first
                while frame is not None:
                    out.write(frame)
                    records, size = records + 1, size + len(frame)
                    if size >= FILE_BYTES:
                        done = False
                        break
                    frame = next(rows, None)
            part += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records]})

    chosen = judged.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return settled(chosen.mapInArrow(run, "file string, records long"), "archive-files")


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _dictionary(given: DataFrame, date: str) -> bytes:
    """Built from the records with the smallest hashes."""
    cut = given.withColumn("html", F.substring("html", 1, SAMPLE_CHARS)).withColumn("refers_to", F.lit(None).cast("long"))
    few = thinned(cut, 2 * SAMPLES / max(1, given.count()), "page_id", "digest")
    sample = few.orderBy(F.xxhash64("page_id", "digest"), "digest").limit(SAMPLES).collect()
    records = [record_of(row.asDict(), date) for row in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return _FRAME.pack(DICTIONARY_FRAME, len(packed)) + packed


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _address(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_of(row: dict, date: str) -> bytes:
    payload = row["html"].encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    body = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"])),
        ("WARC-Target-URI", _address(row["url"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{base32_digest(row['digest'])}"),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"]))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def read_archives(files: DataFrame) -> DataFrame:
    """Every record: ``page_id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to`` and ``payload``.

    Length and digest are those of the full payload. A response's are computed from its payload and must agree
    with what the record says; a revisit has no payload of its own. A damaged file is an error.
    """
    count = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with opened(name) as source:
                    rows = []
                    for record in frames(source):
                        rows.append(_parsed(record, name))
                        if len(rows) == 64:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    kind = (
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
        "payload binary"
    )
    return files.select("file").repartition(max(1, count), "file").mapInArrow(run, kind)


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def frames(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive file, one compressed frame at a time."""
    data, dictionary = source.read(_FRAME.size), None
    if len(data) == _FRAME.size and _FRAME.unpack(data)[0] == DICTIONARY_FRAME:
        dictionary = _loaded(zstandard.ZstdDecompressor().decompress(source.read(_FRAME.unpack(data)[1])))
        data = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data := data or source.read(_CHUNK):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                break
            data = source.read(_CHUNK)
            if not data:
                raise ValueError("archive ends within a record")
        data = frame.unused_data
        yield b"".join(parts)


def _parsed(record: bytes, name: str) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != length or found != digest:
            raise ValueError(f"{name}: damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": _page_id(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }
