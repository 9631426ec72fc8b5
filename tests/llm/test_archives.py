"""Web archives: round trip, revisits, the file format."""

from __future__ import annotations

import base64
import hashlib

import pytest
import zstandard

from conftest import TESTDATA
from sievecraft.llm import warc
from sievecraft.llm.warc import DICTIONARY_FRAME, read_archives, write_archives

KIND = "page_id bigint, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, smallest=0):
    last = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= smallest and page_id is not None:
            last[html or ""] = max(page_id, last.get(html or "", page_id))
    found = []
    for page_id, _, html in rows:
        final = last.get(html or "")
        response = final is None or page_id == final
        refers = None if response else final
        found.append((page_id, len((html or "").encode()), digest(html), "response" if response else "revisit", refers))
    return sorted(found, key=str)


def shown(files):
    rows = read_archives(files).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.mark.parametrize("smallest", [0, 5])
def test_odd_pages(spark, smallest):
    rows = [
        (1, "http://a/", "<p>ä</p>"), (2, "http://a/\r\nWARC-Type: x", "<p>ä</p>"), (3, None, None), (4, "u", ""), (5, "u", "abc"),
        (6, "u", "abc"), (6, "u", "abc"), (None, "u", "abc"), (None, "u", "only"), (7, "u", "\r\n\r\nContent-Length: 3\r\n\r\n"),
        (8, "u", "x" * 400_000),
    ]
    files = write_archives(spark.createDataFrame(rows, KIND).repartition(2), smallest=smallest)
    assert shown(files) == expected(rows, smallest)
    texts = {r.page_id: r.payload.decode() for r in read_archives(files).collect() if r.payload is not None}
    assert texts[7] == rows[9][2] and texts[8] == rows[10][2]


def test_no_pages(spark):
    assert read_archives(write_archives(spark.createDataFrame([], KIND))).count() == 0


def test_a_common_payload(spark):
    rows = [(n, f"u{n}", "common" if n % 3 else f"own {n}") for n in range(600)]
    assert shown(write_archives(spark.createDataFrame(rows, KIND))) == expected(rows)


def test_files_hold_a_dictionary_and_single_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.read.parquet(str(TESTDATA / "sf0.01/pages.parquet")).coalesce(1)
    files = write_archives(pages)
    assert sum(r.records for r in files.collect()) == pages.count() and files.count() > 1
    assert shown(files) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])
    path = files.first().file.removeprefix("file://").removeprefix("file:")
    with open(path, "rb") as source:
        data = source.read()
    assert int.from_bytes(data[:4], "little") == DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and first.endswith(b"\r\n\r\n")
