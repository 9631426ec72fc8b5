"""Token records: exact ids, round trip, damage."""

from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

import corpus_pipeline
from conftest import TESTDATA
from sievecraft.llm.queries import op4_token_records
from sievecraft.llm.token_records import PIECES, PLAIN, cuts_as_known, masked_checksum, read_records, write_records

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (5, "Hello world, it's\n\n 12 tests!", 1), (3, None, 2), (None, "no id", 3), (4, "", 4), (4, "a second four", 5),
    (9, "漢字 <|endoftext|> é　x y\x1cz", 6), (-7, "minus " * 20_000, 7), (4, "", 8),
]


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_plain_texts_are_cut_as_the_pattern_says():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for c in map(chr, range(0x250)):
        for text in (c, "a" + c, "1" + c, " " + c, c + "a", c + "1", "!" + c, f"{c}{c} {c}", "'" + c):
            if PLAIN.fullmatch(text):
                assert PIECES.findall(text) == pattern.findall(text)


def test_records_of_odd_documents(spark, tokenizer):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, ids int").repartition(3)
    shards = write_records(docs, PATH, 2)
    found = sorted(read_records(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, -7, 3, 4, 4, 4, 5, 9]
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in found) == sorted(ids(tokenizer, t) for _, t, _ in ROWS)
    by_id = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found}
    assert all(by_id[d] == ids(tokenizer, t) for d, t, _ in ROWS if d != 4)
    again = read_records(shards, seed=3).collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == list(map(tuple, found))


def test_no_documents(spark):
    assert read_records(write_records(spark.createDataFrame([], "doc_id bigint, text string"), PATH, 2)).count() == 0


def test_documents_of_a_table(spark, tokenizer):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet"))
    found = read_records(write_records(docs, PATH, 2), with_ids=False).orderBy("start").collect()
    start = 0
    for row, doc in zip(found, docs.orderBy("doc_id").collect(), strict=True):
        own = ids(tokenizer, doc.text)
        assert tuple(row) == (doc.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_format_and_damage(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id bigint, text string").coalesce(1)
    shards = write_records(docs, PATH, 2)
    first = shards.orderBy("shard").first()
    path = first.data.removeprefix("file://").removeprefix("file:")
    with open(path, "rb") as source:
        data = source.read()
    length = int.from_bytes(data[:8], "little")
    assert int.from_bytes(data[8:12], "little") == masked_checksum(data[:8])
    assert int.from_bytes(data[12 + length : 16 + length], "little") == masked_checksum(data[12 : 12 + length])
    for place in (3, 13):
        with open(path, "wb") as out:
            out.write(data[:place] + bytes([data[place] ^ 1]) + data[place + 1 :])
        with pytest.raises(PythonException, match="damaged"):
            read_records(shards.where(F.col("data") == first.data)).collect()


@pytest.mark.parametrize("stage", ["query", "pipeline"])
def test_added_tokens_as_the_library_encodes_them(spark, tmp_path, stage):
    """An untouched tokenizer is the reference; plain and other texts hold the content of an added token."""
    rows = [(1, "a <|endoftext|> b", "en", "s", 0), (2, "漢字<|endoftext|>", "en", "s", 0), (3, "<|endoftext", "en", "s", 0), (4, "plain", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op4_token_records(spark, str(tmp_path)) if stage == "query" else corpus_pipeline.token_records(spark, docs, str(tmp_path))
    library = Tokenizer.from_file(PATH)
    assert 50256 in ids(library, rows[0][1])
    expected = {r[0]: zlib.crc32(np.array(ids(library, r[1]), "<u4").tobytes()) for r in rows}
    assert {r.doc_id: r.ids_crc32 for r in found.collect()} == expected


def test_an_added_token_that_is_not_special(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    library.add_tokens(["wor"])
    path = f"{tmp_path}/more.json"
    library.save(path)
    texts = ["hello world", "hello", "no wor d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for special in (False, True):
        found = read_records(write_records(docs, path, 2, special=special)).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found} == {k: ids(library, t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("change", ["prefix", "normalizer", "cutting"])
def test_files_that_cut_in_another_way(spark, tmp_path, change):
    """The cutting made for byte-level files is used for files that ask for it only."""
    library = Tokenizer.from_file(PATH)
    if change == "prefix":
        library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "normalizer":
        library.normalizer = normalizers.Sequence([normalizers.NFKC(), normalizers.Lowercase()])
    else:
        library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    path = f"{tmp_path}/changed.json"
    library.save(path)
    texts = ["Hello world 1234", "ﬁne ½", "漢字 123", "", "  Hello"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = read_records(write_records(docs, path, 2)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found} == {k: ids(library, t) for k, t in enumerate(texts)}
    assert not cuts_as_known(json.loads(library.to_str())) and cuts_as_known(json.loads(Tokenizer.from_file(PATH).to_str()))
