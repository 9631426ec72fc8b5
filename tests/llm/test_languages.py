"""Language identification: held-out accuracy, rejection, odd texts."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import pytest

from conftest import TESTDATA
from sievecraft.llm import language_id
from sievecraft.llm.language_id import fit, held_out, ngram_counts, predict, sampled
from sievecraft.llm.queries import op3_language_id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def model(docs):
    return fit(docs.where(~held_out()))


def test_held_out_accuracy(spark, docs):
    found = op3_language_id(spark, str(TESTDATA / "sf0.01")).collect()
    labels = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    tested = [r.lang_pred == labels[r.doc_id] for r in found if r.held_out]
    assert len(tested) > 200 and sum(tested) >= 0.97 * len(tested)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)


def test_several_centroids_for_each_language(model):
    assert set(model.languages) == {"de", "en", "es", "fr"}
    assert all(model.languages.count(lang) > 1 for lang in set(model.languages))


def test_predictions_use_the_text_only(docs, model):
    plain = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs.limit(50), model).collect()}
    moved = docs.limit(50).selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'yy' AS source")
    assert {r.doc_id - 1000000: (r.lang_pred, r.score) for r in predict(moved, model).collect()} == plain


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "русский текст о погоде"), (5, "x"), (6, "the and of " * 50_000), (7, "漢字仮名")]
    found = predict(spark.createDataFrame(rows, "score int, text string"), model, "text")
    assert found.columns == ["text", "lang_pred", "score", "rejected"]
    by_text = {r.text: r for r in found.collect()}
    for text in (None, "", "12 34 !?"):
        assert (by_text[text].lang_pred, by_text[text].score, by_text[text].rejected) == ("und", 0.0, True)
    assert by_text["русский текст о погоде"].rejected and by_text["漢字仮名"].rejected
    assert by_text["the and of " * 50_000].lang_pred == "en" and not by_text["the and of " * 50_000].rejected


def test_nothing_to_learn_from(spark):
    kind = "doc_id bigint, text string, lang string"
    for rows in ([], [(1, "text", None)], [(1, None, "en")], [(1, "123", "en")]):
        empty = fit(spark.createDataFrame(rows, kind))
        found = predict(spark.createDataFrame([(1, "a text", "en")], kind), empty).first()
        assert (found.lang_pred, found.score, found.rejected) == ("und", 0.0, True)
    one = fit(spark.createDataFrame([(1, "ein satz", "de"), (1, "ein satz", "de"), (2, "?", "en")], kind))
    assert predict(spark.createDataFrame([(5, "satz", None)], kind), one).first().lang_pred == "de"


FINNISH = (
    "Suomen kesä on lyhyt mutta kaunis, ja monet ihmiset viettävät sen mökillä järven rannalla. Illalla saunotaan, "
    "uidaan ja grillataan makkaraa, ja yöllä aurinko tuskin laskee. Syksyllä metsästä kerätään marjoja ja sieniä, "
    "joita riittää kaikille. Talvella taas on pimeää ja lunta sataa paljon."
)
DUTCH = (
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en "
    "behoren zich jegens elkander in een geest van broederschap te gedragen. In de winter schaatsen wij graag op het ijs."
)


def foreign_texts():
    random_ = random.Random(5)
    found = [FINNISH, FINNISH[:40], FINNISH * 20, DUTCH, DUTCH * 20]
    for n in (40, 300, 3000, 30_000):
        found.append(base64.b64encode(random_.randbytes(n)).decode())
        for first, last in ((0x61, 0x7A), (0x430, 0x44F), (0x4E00, 0x9FA4), (0xAC00, 0xD7A2)):
            found.append("".join(chr(random_.randint(first, last)) if random_.random() > 0.15 else " " for _ in range(n)))
    return found


def test_foreign_and_random_texts_are_rejected(spark, model):
    docs = spark.createDataFrame(list(enumerate(foreign_texts())), "n int, text string")
    passed = predict(docs, model).where("NOT rejected")
    assert [(r.n, r.lang_pred, r.score) for r in passed.drop("text").collect()] == []


def test_texts_of_the_languages_are_kept_whole_and_cut(docs, model):
    assert predict(docs.where(held_out()), model).where("rejected AND score > 0").count() == 0
    for size in (30, 100, 1000):
        cut = predict(docs.where(held_out()).selectExpr(f"substr(text, 1, {size}) AS text"), model).where("score > 0")
        assert cut.where("rejected").count() <= 0.01 * cut.count()


def test_too_many_languages_are_an_error(spark, monkeypatch):
    """Also if each has few texts, and so fewer centroids than others."""
    docs = spark.createDataFrame([(k, f"text of language {'abcdefghij'[k]}", f"l{k}") for k in range(10)], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 10)
    assert len(set(fit(docs).languages)) == 10
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="3 languages"):
        fit(docs)


def test_an_id_with_very_many_rows(spark):
    """A language is fitted on a bounded number of rows, however many share an id; reruns agree."""
    rows = [(1, f"the very same id again {'abcdefghijklmnopqrstuvwxyz'[k % 26] * (k % 40 + 1)}", "en") for k in range(3000)]
    rows += [(1, "always the same row", "en")] * 3000
    rows += [(k, f"ein anderer satz mit {'xyz'[k % 3] * k}", "de") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    assert {r.lang: r["count"] for r in sampled(docs, 50).groupBy("lang").count().collect()} == {"en": 50, "de": 28}
    assert sampled(docs, 50).where("text = 'always the same row'").count() <= 1
    found, again = fit(docs, per_language=50), fit(docs.repartition(7), per_language=50)
    assert found.languages == again.languages and np.array_equal(found.centroids, again.centroids)


def test_predictions_against_brute_force(docs, model):
    """Counts of n-grams by plain Python, idf, cosine and nearest centroid one text at a time."""
    for row in predict(docs.where("doc_id % 9 = 0"), model).collect():
        counts = brute_counts(row.text or "")
        if not counts:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        weights = {f: np.log1p(n) * float(model.idf[f]) for f, n in counts.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * float(c[f]) for f, w in weights.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosines))
        assert abs(row.score - max(cosines)) < 1e-4
        assert row.lang_pred == model.languages[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5


def brute_counts(text):
    """Hashes of the 2- and 3-grams of letters, words one space apart, between spaces; what follows the last letter is one more."""
    blanked = "".join(c if c.isalpha() else " " for c in text.lower())
    words = blanked.split()
    if not words:
        return {}
    points = [ord(c) for c in " " + " ".join(words) + "  "[: 1 + blanked.endswith(" ")]]
    counts = {}
    for k in range(len(points) - 1):
        pair = (points[k] * 0x9E3779B1 + points[k + 1] * 0x85EBCA77) & 0xFFFFFFFF
        found = [pair >> 19]
        if k + 2 < len(points):
            found.append(((pair * 0xC2B2AE3D + points[k + 2] * 0x27D4EB2F) & 0xFFFFFFFF) >> 19)
        for f in found:
            counts[f] = counts.get(f, 0) + 1
    return counts


def test_brute_counts_are_those_of_the_library():
    for text in (FINNISH, DUTCH, "a", "x1y", "  Ä b", "漢字 仮名"):
        found = ngram_counts(text)
        assert {int(f): int(found[f]) for f in np.flatnonzero(found)} == brute_counts(text)
    assert ngram_counts("1 2") is None and brute_counts("1 2") == {}
