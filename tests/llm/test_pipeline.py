"""The registered queries, their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from compare import rows_of_duck, rows_of_spark
from conftest import TESTDATA
from sievecraft.llm import queries
from sievecraft.llm.scratch import settled
from test_groups import joined, similar, word_set
from test_native import brute_hits

OPS = queries.queries()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS FROM '{TESTDATA}/sf0.01/{name}.parquet'")
    yield con
    con.close()


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in OPS) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(OPS)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, tables, name):
    assert rows_of_spark(OPS[name](spark, str(TESTDATA / "sf0.01"))) == rows_of_duck(tables, queries.oracle_sql()[name])


def test_stages(spark):
    folder = str(TESTDATA / "sf0.001")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [re.sub("_.*", "", n) for n in names] == ["language", "minhash", "decontamination", "mixing", "token"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(settled(stage(spark, results[-1], folder), name))
    assert all(df.columns == docs.columns for df in results[:-1])
    given, spoken, single, clean, mixed = ([tuple(r) for r in df.collect()] for df in results[:-1])
    assert {r[0] for r in given if any(map(str.isalpha, r[1] or ""))} == {r[0] for r in spoken}

    sets = {r[0]: word_set(r[1], 5) for r in spoken}
    assert sorted(r[0] for r in single) == sorted(n for n, c in joined(sets, similar(sets)).items() if n == c)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in brute_hits([r[:2] for r in single], items) if n}
    assert hit and sorted(clean) == sorted(r for r in single if r[0] not in hit)

    sizes = {r[0]: len((r[1] or "").split()) for r in clean}
    took = Counter()
    for r in mixed:
        took[r[0]] += len(r[1].split())
        assert len(r[1]) == r[4]
    assert all(took[d] <= 2 * sizes[d] for d in took) and abs(sum(took.values()) / sum(sizes.values()) - 1.5) < 0.05

    records = results[-1].orderBy("start").collect()
    assert Counter(r.doc_id for r in records) == Counter(r[0] for r in mixed)
    assert [r.start for r in records] == [0, *np.cumsum([r.n_tokens for r in records])[:-1]]
    assert [r.doc_id for r in records] == sorted(r.doc_id for r in records)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, records))


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node int, word string, members int, row int"
SPEECH = {
    "en": "the river runs down from the hills and the people of the town walk along it in the evening",
    "fr": "la rivière descend des collines et les habitants de la ville marchent le long de ses rives le soir",
}
PASSAGE = "seven grey herons stood under an iron bridge while rain fell upon quiet northern water"


def odd_documents():
    """Two languages, each text with words of its own, and rows with every oddity."""
    rows = []
    for k in range(60):
        lang = ("en", "fr")[k % 2]
        own = " ".join(f"{w}{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for w in SPEECH[lang].split()[: 6 + k % 5])
        rows.append((k, f"{SPEECH[lang]} {own}", lang, ("a", "b", None)[k % 3]))
    rows += [
        (100, None, "en", "a"), (101, "", "en", "a"), (102, " 12 \t 34", None, None), (None, rows[0][1], "en", "a"), (None, None, None, None),
        (103, rows[2][1], None, None), (103, rows[2][1], None, None), rows[4], (4, rows[6][1] + " more", "en", "b"),
        (104, f"{SPEECH['en']} {PASSAGE}", "en", "b"), (105, (SPEECH["en"] + " and ") * 3000, "en", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "k", None, "w", 2, 1) for r in rows]


def given_text(given, doc_id):
    """The id with the text that it repeats."""
    return next(row for row, n in Counter(r[:2] for r in given).items() if row[0] == doc_id and n > 1)


@pytest.fixture(scope="module")
def odd_results(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_documents(), ODD).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, PASSAGE), (2, None), (3, ""), (None, "no such words stand in any document of this small odd table"), (1, PASSAGE)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    results = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        results.append(settled(stage(spark, results[-1], folder), name))
    return folder, results


def test_stages_on_odd_rows(spark, odd_results):
    """Texts without a letter go, copies and near copies leave one doc_id, a passage goes, and extra columns stay as they are."""
    _, results = odd_results
    assert all(df.columns == results[0].columns for df in results[:-1])
    given, spoken, single, clean, mixed = ([tuple(r) for r in df.collect()] for df in results[:-1])
    without = Counter(r[:2] for r in given) - Counter(r[:2] for r in spoken)
    assert {(100, None), (101, ""), (102, " 12 \t 34"), (None, None)} <= set(without)
    # Without an id a row is judged by its text like any other.
    assert {r[0] for r in spoken if r[0] is not None} >= set(range(60)) and all(r[5:] == ("k", None, "w", 2, 1) for r in spoken)

    # Rows that repeat a doc_id and its text are one document, and stay or go together.
    assert Counter(r[:2] for r in single)[given_text(given, 4)] == 2
    texts = Counter(text for _, text in {r[:2] for r in single})
    assert max(texts.values()) == 1 and {r[1] for r in single} <= {r[1] for r in spoken}
    assert set(single) <= set(spoken) and all(r[0] is not None for r in single)
    sets = {text: word_set(text, 5) for text in {r[1] for r in spoken}}
    kept = list(texts)
    assert not any(similar({0: sets[a], 1: sets[b]}) for k, a in enumerate(kept) for b in kept[:k])

    assert {r[0] for r in single} - {r[0] for r in clean} == {104}
    assert Counter(clean) <= Counter(single)
    sizes, took = Counter(), Counter()
    for r in clean:
        sizes[r[0]] += len(r[1].split())
    for r in mixed:
        took[r[0]] += len(r[1].split())
    assert set(took) <= set(sizes) and all(took[d] <= 2 * sizes[d] for d in took)
    assert all(r[4] == len(r[1]) and r[5:] == ("k", None, "w", 2, 1) for r in mixed)
    records = results[-1].orderBy("start").collect()
    assert Counter(r.doc_id for r in records) == Counter(r[0] for r in mixed)
    assert [r.start for r in records] == [0, *np.cumsum([r.n_tokens for r in records])[:-1]]


@pytest.mark.parametrize("left", ["none", "nulls"])
def test_stages_on_empty_tables(spark, tmp_path, left):
    """No documents, or none with a text, give no rows in any stage, in the columns given."""
    rows = [] if left == "none" else [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        result = settled(stage(spark, empty, str(tmp_path)), name)
        assert result.count() == 0
        assert result.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "token_records" else docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
