"""Components, near-duplicate documents and lines, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from sievecraft.llm import line_dedup, minhash_dedup, near
from sievecraft.llm.components import components
from sievecraft.llm.line_dedup import deduplicate_lines, line_classes
from sievecraft.llm.minhash_dedup import drop_near_duplicates, near_duplicates

DOCS = "doc_id bigint, text string"


def joined(nodes, links):
    """The smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def similar(sets, percent=80):
    """Links of all pairs of non-empty sets, by an inverted index."""
    index, links = {}, []
    for n, s in sets.items():
        shared = Counter(m for x in s for m in index.get(x, ()))
        links += [(m, n) for m, k in shared.items() if 100 * k >= percent * (len(s) + len(sets[m]) - k)]
        for x in s:
            index.setdefault(x, []).append(n)
    return links


def word_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def edited(random_, words, share):
    return [random_.choice("abcdefgh") * 3 + str(random_.random()) if random_.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    """A text with hundreds of near copies, some of which are linked only through others, and unrelated texts."""
    random_ = random.Random(4)
    base = [f"w{random_.randrange(400)}" for _ in range(120)]
    texts = [" ".join(edited(random_, base, random_.choice([0, 0.01, 0.03, 0.05]))) for _ in range(300)]
    texts += [" ".join(f"v{random_.randrange(4000)}" for _ in range(random_.randrange(1, 80))) for _ in range(120)]
    texts += [texts[3]] * 40
    random_.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (3, None)], [(k, k + 1) for k in range(40)]])
def test_components_of_small_graphs(spark, links):
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert found == joined({n for link in real for n in link}, real)


def test_components_of_a_random_graph(spark):
    random_ = random.Random(1)
    links = [(random_.randrange(900), random_.randrange(900)) for _ in range(500)] + [(0, k) for k in range(1000, 1400)]
    links = [(a, b) for a, b in links if a != b]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == joined({n for link in links for n in link}, links)


def test_every_close_signature_meets_in_a_key(spark):
    """Signatures that differ in up to the guaranteed number of slots share a key."""
    random_ = np.random.default_rng(0)
    one = random_.integers(0, 1 << 16, minhash_dedup.SLOTS, dtype=np.uint16)
    rows = [(0, one.tobytes())]
    for n in range(1, 60):
        other = one.copy()
        other[random_.choice(minhash_dedup.SLOTS, minhash_dedup.GUARANTEED, replace=False)] ^= 1
        rows.append((n, other.tobytes()))
    keyed = spark.createDataFrame(rows, "node bigint, signature binary").select(
        "node", F.posexplode(F.array(*minhash_dedup._key_columns()))
    )
    own = keyed.where("node = 0").select("pos", "col")
    assert keyed.join(own, ["pos", "col"]).select("node").distinct().count() == len(rows)


def test_forest_connects_what_the_matrix_connects():
    random_ = np.random.default_rng(2)
    for _ in range(50):
        matrix = random_.random((random_.integers(1, 9), random_.integers(1, 9))) < 0.2
        rows, columns = near.forest(matrix)
        cells = [(int(r), 100 + int(c)) for r, c in zip(*np.nonzero(matrix), strict=True)]
        nodes = {n for cell in cells for n in cell}
        chosen = [(int(r), 100 + int(c)) for r, c in zip(rows, columns, strict=True)]
        assert joined(nodes, chosen) == joined(nodes, cells) and len(chosen) < max(1, len(nodes))


def test_groups_survive_batch_borders():
    table = pa.table({"key": [1, 1, 1, 2, 3, 3], "i": [0] * 6, "j": [0, 0, 1, 0, 0, 0], "x": list(range(6))})
    for size in (1, 2, 4, 6):
        found = []
        for whole, starts in near.whole_groups(iter(table.to_batches(max_chunksize=size))):
            values = whole.column("x").to_pylist()
            found += [values[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert found == [[0, 1], [2], [3], [4, 5]]


@pytest.mark.parametrize("blocks", [None, 16])
def test_near_duplicates_of_many_copies(spark, monkeypatch, copies, blocks):
    if blocks:
        monkeypatch.setattr(minhash_dedup, "SIGNATURE_BLOCK", blocks)
        monkeypatch.setattr(minhash_dedup, "SET_BLOCK", blocks)
    found = near_duplicates(spark.createDataFrame(copies, DOCS).repartition(5), width=4).collect()
    sets = {n: word_set(text, 4) for n, text in copies}
    expected = joined(sets, similar(sets))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        n: (len(sets[n]), c, c == n) for n, c in expected.items()
    }


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet"))
    sets = {r.doc_id: word_set(r.text, 5) for r in docs.collect()}
    expected = joined(sets, similar(sets))
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == expected
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(n for n, c in expected.items() if n == c)


def test_odd_documents(spark):
    long = "one two three four five six " * 4000
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "Two words", "d"), (5, "two WORDS", "e"), (6, long, "f"),
        (7, long + "seven", "g"), (8, "ÄB c", "h"), (9, "äb c", "i"), (None, "two words", "j"), (None, "alone here", "k"),
        (4, "Two words", "d"), (4, "something else entirely", "l"), (10, "x\x1cy", "m"), (11, "x y", "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    found = sorted(near_duplicates(docs, width=4).drop("text_hash").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles, str(r.component_id)))
    assert [tuple(r) for r in found] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True),
        (5, 1, 4, False), (6, 6, 6, True), (7, 7, 6, False), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 10, True),
        (11, 1, 11, True), (None, 1, 4, False), (None, 1, None, True),
    ]
    kept = drop_near_duplicates(docs, width=4)
    assert kept.columns == docs.columns
    assert sorted(r.component_id for r in kept.collect()) == list("abcddfhiklmn")


LONG = " ".join(f"w{k}" for k in range(60))


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_one_id_for_several_texts(spark, kind):
    """A text is not dragged along by another one of its id."""
    rows = [(3, LONG + " x"), (5, LONG), (5, "an unrelated text of five words and more"), (7, "one more text that nothing else is like"), (7, LONG + " y")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text").repartition(3)
    found = {(str(r.doc_id), r.n_shingles): (str(r.component_id), r.kept) for r in near_duplicates(docs).collect()}
    assert found == {("3", 57): ("3", True), ("5", 56): ("3", False), ("5", 4): ("5", True), ("7", 4): ("7", True), ("7", 57): ("3", False)}
    assert sorted(r.text for r in drop_near_duplicates(docs).collect()) == sorted(rows[k][1] for k in (0, 2, 3))


def test_near_sets_without_id(spark):
    """They join the class of a near copy with an id; a class that has none is kept whole."""
    rows = [(None, LONG + " x"), (9, LONG), (None, LONG + " x"), (None, LONG[::-1] + " a"), (None, LONG[::-1] + " b"), (8, LONG + " z")]
    found = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == {
        (None, 8, False): 2, (9, 8, False): 1, (8, 8, True): 1, (None, None, True): 2,
    }


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0
    assert line_classes(none).count() == 0 and deduplicate_lines(none).count() == 0


def brute_lines(rows):
    lines = {(d, k): line.strip().lower() for d, text in rows for k, line in enumerate((text or "").split("\n"))}
    places = {}
    for place, line in sorted(lines.items()):
        if line:
            places.setdefault(line, place)
    sets = {place: {line[k : k + 8] for k in range(max(1, len(line) - 7))} for line, place in places.items()}
    heads = joined(sets, similar(sets))
    return {
        place: (*heads[places[line]], heads[places[line]] == place) if line else (None, None, True)
        for place, line in lines.items()
    }


@pytest.mark.parametrize("blocks", [None, 8])
def test_lines_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(line_dedup, "SIGNATURE_BLOCK", blocks)
        monkeypatch.setattr(line_dedup, "SET_BLOCK", blocks)
    docs = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet")).select("doc_id", "text")
    random_ = random.Random(8)
    base = "a line of some length that is repeated with small changes in very many of the documents"
    rows = [tuple(r) for r in docs.collect()]
    for n in range(60):
        at = random_.randrange(len(base))
        rows.append((1000 + n, f"unrelated {random_.random()}\n{base[:at]}{random_.choice('xyz')}{base[at + 1:]}\n\n {base.upper()}"))
    found = line_classes(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line, r.kept) for r in found} == brute_lines(rows)


def test_odd_lines(spark):
    rows = [
        (2, "same line here\nother\n\nsame line here", "x"), (1, None, "y"), (3, "", "z"), (4, "  SAME LINE HERE ", "u"),
        (None, "short\nshort", "v"), (5, "short", "w"), (6, "a" * 300_000, "s"), (7, "a" * 8, "t"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line string")
    found = {r.line: r.text for r in deduplicate_lines(docs).collect()}
    assert found == {
        "x": "same line here\nother\n", "y": None, "z": "", "u": "", "v": "short", "w": "", "s": "a" * 300_000, "t": "",
    }


@pytest.mark.parametrize("kind", ["int", "string"])
def test_lines_of_other_ids(spark, kind):
    docs = spark.createDataFrame([(7, "a line that is here twice\nown"), (9, "a line that is here twice"), (None, "own ")], DOCS)
    found = line_classes(docs.selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")).collect()
    first = int if kind == "int" else str
    assert sorted(((r.doc_id, r.line, r.first_doc_id, r.first_line, r.kept) for r in found), key=str) == sorted(
        [(first(7), 0, first(7), 0, True), (first(7), 1, None, 0, False), (first(9), 0, first(7), 0, False), (None, 0, None, 0, True)], key=str
    )


def test_keys_are_passed_on_in_filled_ranges():
    """Small batches of a task become one, and ranges without keys no row."""
    rows = line_dedup.signatures([f"line {k} of some that differ" for k in range(30)])
    batches = [pa.record_batch({"signature": pa.array([r.tobytes()], pa.binary())}) for r in rows]
    batches.insert(3, batches[0].slice(0, 0))
    found = pa.Table.from_batches(line_dedup._short_keys(iter(batches), 1 << 16)).to_pylist()
    keys = np.sort((line_dedup.band_keys([r.tobytes() for r in rows]).ravel() >> np.uint64(32)).astype(np.uint32))
    assert len(found) == len({int(k) >> 16 for k in keys}) and all(r["short"] for r in found)
    assert b"".join(r["short"] for r in found) == keys.tobytes()
    assert all((int(k) >> 16) == r["range"] for r in found for k in np.frombuffer(r["short"], np.uint32))
    assert list(line_dedup._short_keys(iter([]), 256)) == []


@pytest.mark.parametrize("operator", [near_duplicates, drop_near_duplicates, line_classes, deduplicate_lines])
def test_similarities_that_signatures_would_lose_are_an_error(spark, operator):
    docs = spark.createDataFrame([(1, "a text"), (2, "a text")], DOCS)
    for percent in (50, 79, 101):
        with pytest.raises(ValueError, match="percent"):
            operator(docs, percent=percent)
    assert operator(docs, percent=80).count() == 2 - (operator is drop_near_duplicates)


def test_a_link_whose_signatures_differ_more_than_usual(spark):
    """Similarity 4 / 5, but 29 of the 64 slots differ, found by a search; all up to the guaranteed number are compared."""
    rows = [(1, "w1741 w1 w693 w2782"), (2, "w1741 w1 w693 w2782 w318")]
    one, two = (minhash_dedup.signature(minhash_dedup.word_shingles(text, 1), minhash_dedup.SLOTS) for _, text in rows)
    assert 28 < (one != two).sum() <= minhash_dedup.GUARANTEED
    found = near_duplicates(spark.createDataFrame(rows, DOCS), width=1).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (2, 1, False)]
