"""SentencePiece encoding: equal to the library on tables, odd and random texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from conftest import TESTDATA
from sievecraft.llm.piece_bpe import Vocabulary, encode, encoded, vocabulary
from sievecraft.llm.queries import op12_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   a", "hello  world   x", "a\tb\r\n\n\nc", "▁▁ x ▁y", "\0 nul \x01", "日本語テキスト 漢字", "🤗🏳️‍🌈", "<s> </s> <unk> <0x41>",
    "﻿bom ​", "\U0010ffff", "é é", "Hello" * 500, " " * 3000 + "x", "x" + " " * 700, "=" * 999, "日" * 500, "a" * 5000 + " b",
]


def library(texts):
    return vocabulary(PATH).library.encode(texts, add_bos=True, add_eos=True, num_threads=1)


def own(texts):
    return [ids.tolist() for ids in encode(texts, vocabulary(PATH))]


def test_odd_texts():
    assert own(ODD) == library(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=6))
def test_any_texts(texts):
    assert own(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab e\nthing▁ .=-", max_size=120), min_size=1, max_size=6))
def test_texts_of_few_characters(texts):
    assert own(texts) == library(texts)


def test_random_letters_and_pieces():
    rng = random.Random(5)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(rng.randint(1, 60))) for k in range(1, 27) for _ in range(60)]
    pieces = [vocabulary(PATH).library.id_to_piece(k) for k in range(259, 32_000)]
    joined = ["".join(rng.choice(pieces) for _ in range(8)).replace("▁", " ") for _ in range(3000)]
    assert own(letters + joined) == library(letters + joined)


def small_model(folder, pieces, **trainer):
    """A model of our own: base characters and ``pieces`` (text, score)."""
    model = ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    kept = [p for p in model.pieces if p.type in (2, 3, 6)]
    del model.pieces[:]
    model.pieces.extend(kept)
    for text, score in pieces:
        model.pieces.add(piece=text, score=score, type=1)
    for name, value in trainer.items():
        setattr(model.trainer_spec, name, value)
    path = f"{folder}/small.model"
    with open(path, "wb") as out:
        out.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("scores", range(40))
def test_vocabularies_whose_ranks_are_in_any_order(tmp_path, scores):
    """Pieces may rank before those they are made of, and may share ranks."""
    rng = random.Random(scores)
    texts = {"".join(rng.choice("ab▁") for _ in range(rng.randint(2, 6))) for _ in range(30)}
    pieces = [(c, -100.0) for c in "ab▁"] + [(t, -float(rng.randint(1, 3 if scores % 2 else 40))) for t in sorted(texts)]
    known = Vocabulary(small_model(tmp_path, pieces))
    lines = ["".join(rng.choice("aabb ") for _ in range(rng.randint(0, 150))) for _ in range(60)] + ["a" * 300, "ab" * 200, " " * 300]
    assert [ids.tolist() for ids in encode(lines, known)] == known.library.encode(lines, add_bos=True, add_eos=True, num_threads=1)


def test_other_models_are_an_error(tmp_path):
    for changes in ({"model_type": 1}, {"byte_fallback": False}):
        with pytest.raises(ValueError, match="byte-pair"):
            Vocabulary(small_model(tmp_path, [("a", -1.0)], **changes))


def test_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, ids int, decoded string").repartition(3)
    found = encoded(docs, PATH).collect()
    expected = library([t or "" for _, t in rows])
    decoded = [vocabulary(PATH).library.decode(ids) for ids in expected]
    want = sorted(((d is None, d or 0), ids, text) for (d, _), ids, text in zip(rows, expected, decoded, strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids, r.decoded) for r in found) == want
    assert encoded(docs.where("false"), PATH).count() == 0


def test_documents_of_a_table(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet")).collect()
    found = {r.doc_id: r for r in op12_sentencepiece(spark, str(TESTDATA / "sf0.01")).collect()}
    assert len(found) == len(docs)
    for doc, ids in zip(docs, library([d.text or "" for d in docs]), strict=True):
        row = found[doc.doc_id]
        text = vocabulary(PATH).library.decode(ids)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
