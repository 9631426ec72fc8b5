"""License scan, mixing, decontamination and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from sievecraft.llm import decontaminate as spans
from sievecraft.llm import chat
from sievecraft.llm.chat import END, START, formatted_conversations, loss_text, unescape
from sievecraft.llm.decontaminate import contamination, decontaminate
from sievecraft.llm.license_rules import BASE, rules
from sievecraft.llm.license_scan import label_list, scan, score
from sievecraft.llm.mixing import _alias_table, _permuted, mixed_documents, mixture, sized_rows, taken_words, targets
from sievecraft.llm.queries import op5_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP_TO_LOW = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string"


def words(text):
    return WORD.findall((text or "").translate(UP_TO_LOW))


def no_python(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# License scan


def brute_scan(text):
    found = words(text)
    padded = f" {' '.join(found)} "
    seen = []
    for rule in rules():
        if rule.keyword in found:
            for m in re.finditer(rule.pattern, padded):
                start = padded.count(" ", 0, m.start()) - 1
                seen.append((start, start + m[0].count(" ") + 1, rule.tier, rule.order, rule.label))
    seen.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept = [
        d for k, d in enumerate(seen) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] for e in seen[:k])
    ]
    return len(found), [d for d in seen if d[3] < len(BASE)], kept


LICENSES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); see the MIT license file.",
    "This work is licensed under the GNU General Public License, version 3. SPDX-License-Identifier: GPL-3.0-or-later",
    "gnu general public license " * 30, "CC BY-SA 4.0, cc-by, CC\nBY!", "creative commons attribution share alike 4.0 and public domain",
    "mit license" * 3, "MİT License", "KIT license mit  LICENSE", "", None, "no notice here " * 20_000 + "bsd license",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "the mit x11 license",
]


def test_hundreds_of_rules():
    found = rules()
    assert len(found) >= 200 and [r.order for r in found] == list(range(len(found)))
    assert [(r.label, r.keyword) for r in found[: len(BASE)]] == [(label, word) for label, _, word in BASE]
    for rule in found:
        assert re.search(rf"\b{rule.keyword}\b", rule.pattern.replace("?:", "")), rule


def test_scan_of_notices(spark):
    docs = spark.createDataFrame([*enumerate(LICENSES), (0, LICENSES[0])], "doc_id bigint, text string").withColumn("base", F.lit(1))
    rows = scan(docs)
    assert no_python(rows) and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = rows.collect()
    assert len(found) == len(LICENSES) + 1
    for row in found:
        n, base, kept = brute_scan(LICENSES[row.doc_id])
        assert (row.n_words, [tuple(d) for d in row.base], [tuple(d) for d in row.kept]) == (n, base, kept)
    assert scan(spark.createDataFrame([], DOCS)).count() == 0


def test_labels_and_score(spark):
    found = {
        r.doc_id: (r.labels, r.score)
        for r in scan(spark.createDataFrame(list(enumerate(LICENSES)), DOCS))
        .select("doc_id", label_list(F.col("base"), F.col("kept")).alias("labels"), score(F.col("kept")).alias("score"))
        .collect()
    }
    assert found[0] == ("apache,apache-2.0,license-file,mit", 1.0) and found[2] == ("gpl", 0.8) and found[9] == ("", 0.0)


def test_base_phrases_of_the_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet")).collect()}
    hits = 0
    for row in op5_license_scan(spark, str(TESTDATA / "sf0.01")).collect():
        own = words(docs[row.doc_id])
        places = [(k, label) for label, phrase, _ in BASE for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (
            len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
        )
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(","))) and 0 <= row.score <= 1
        hits += bool(places)
    assert hits


# Mixing


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert targets([10, 0, 1000], [5, 2, 1], 1.5, 2) == pytest.approx([20, 0, 1495])
    assert targets([], [], 1.5, 2) == [] and targets([0], [1], 1.5, 2) == [0]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutations_reach_every_index_once(spark, n):
    table = spark.range(n).withColumns({"n": F.lit(n), "s": F.lit("seed")})
    found = {}
    for epoch in (0, 1):
        mapped = table.select(_permuted(F.col("id"), F.col("n"), F.col("s"), F.lit(epoch))).collect()
        found[epoch] = [r[0] for r in mapped]
        assert sorted(found[epoch]) == list(range(n))
    if n == 1000:
        # Neighbours go to places that have nothing to do with each other, and differently in each pass.
        steps = Counter((b - a) % n for a, b in zip(found[0], found[0][1:], strict=False))
        assert steps.most_common(1)[0][1] < 12 and sum(a == b for a, b in zip(found[0], found[1], strict=True)) < 10
        fixed = sum(a == k for k, a in enumerate(found[0]))
        assert fixed < 10


def test_alias_tables_hold_the_shares():
    for shares in ([1.0], [0.5, 0.5], [0.7, 0.2, 0.1], [0.01] * 50 + [0.5]):
        keep, alias = _alias_table(shares)
        got = [0.0] * len(shares)
        for k, (stay, other) in enumerate(zip(keep, alias, strict=True)):
            got[k] += stay / len(shares)
            got[other] += (1 - stay) / len(shares)
        assert got == pytest.approx(shares)


ODD = [
    (1, "a", "one two three"), (1, "a", "one two three"), (2, "a", None), (3, "b", ""), (4, None, "x " * 900), (5, "c", "y\x0bz"),
    (None, "b", "w " * 5000), (6, "a", "v " * 300),
]


def test_mix_of_odd_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, source string, text string").withColumn("row", F.lit("clash"))
    mix = mixture(sized_rows(docs), block=16, shard=64)
    sources = {r.source: r for r in mix.sources.collect()}
    assert list(sources) == ["a", "b", "c", None]
    found = taken_words(mix).collect()
    assert len(found) == len(ODD) and all(r.taken <= 2 * r["size"] for r in found)
    names = {r.id: r.source for r in sources.values()}
    took = Counter()
    for r in found:
        took[names[r.source_id]] += r.taken
    for source, r in sources.items():
        assert abs(took[source] - r.target) <= 16 + 0.02 * r.target
    assert sorted(map(tuple, taken_words(mixture(sized_rows(docs), block=16, shard=64)).collect()), key=str) == sorted(map(tuple, found), key=str)


def test_mix_does_not_depend_on_splits(spark, tmp_path, configured):
    """Neither on how a table is cut or ordered, nor on the cores; copies are interchangeable."""
    docs = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet")).unionByName(
        spark.createDataFrame([(r[0], r[2], "en", r[1], 1) for r in ODD + ODD[:1] * 2500], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    )
    docs.repartition(3).write.parquet(f"{tmp_path}/a")
    docs.repartition(11, "n_chars").sortWithinPartitions(F.desc("text")).write.parquet(f"{tmp_path}/b")
    found = []
    for name, split, partitions in (("a", "128MB", "8"), ("b", "20KB", "3")):
        configured(spark__sql__files__maxPartitionBytes=split, spark__sql__files__openCostInBytes="1", spark__sql__shuffle__partitions=partitions)
        given = spark.read.parquet(f"{tmp_path}/{name}")
        taken = Counter(map(tuple, taken_words(mixture(sized_rows(given), block=16, shard=500)).collect()))
        mixed = Counter(map(tuple, mixed_documents(given, block=16, shard=500).collect()))
        found.append((given.rdd.getNumPartitions(), taken, mixed))
    assert found[0][0] != found[1][0] and found[0][1:] == found[1][1:]
    assert found[0][1].total() == docs.count()


def test_mix_against_brute_force(spark):
    """Targets, totals and which words are taken, from slots and pieces joined in Python."""
    docs = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet"))
    mix = mixture(sized_rows(docs), block=32, shard=300)
    rows = [(r.doc_id, r.source, len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])) for r in docs.collect()]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    wanted = targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    assert [(r.source, r["size"], r.target) for r in mix.sources.collect()] == list(zip(names, sizes, wanted, strict=True))
    times = Counter((r.source_id, r.block) for r in mix.slots.collect())
    taken = Counter()
    for p in mix.pieces.collect():
        taken[p.doc_id] += (p.words or 0) * times[p.source_id, p.block]
        assert p.words is None or p.start + p.words <= p["size"]
    assert {r.doc_id: r.taken for r in taken_words(mix).collect()} == {d: taken[d] for d, _, _ in rows}
    for k, name in enumerate(names):
        own = sum(taken[d] for d, s, _ in rows if s == name)
        assert abs(own - wanted[k]) <= 64 + 0.02 * wanted[k]


def test_slots_follow_the_draw(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet"))
    mix = mixture(sized_rows(docs), block=32, shard=1000)
    slots = mix.slots.collect()
    sources = {r.id: r for r in mix.sources.collect()}
    assert no_python(mix.slots) and sorted(r.slot for r in slots) == list(range(len(slots)))
    assert Counter(r.source_id for r in slots) == {k: r.quota for k, r in sources.items() if r.quota}
    for (source, block), n in Counter((r.source_id, r.block) for r in slots).items():
        assert 0 <= block < sources[source].blocks and n <= 2
    # Counts vary between shards as those of independent draws do.
    share = sources[0].quota / len(slots)
    counts = Counter(r.shard for r in slots if r.source_id == 0)
    full = [counts[s] for s in range(len(slots) // 1000)]
    spread = sum((c - 1000 * share) ** 2 for c in full) / len(full) / (1000 * share * (1 - share))
    assert 0.3 < spread < 2.5


def test_mixed_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, source string, text string").withColumn("n_chars", F.length("text"))
    mixed = mixed_documents(docs, block=16, shard=64)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    size = sum(len((r.text or "").split()) for r in rows)
    total = sum(len((t or "").split()) for _, _, t in ODD)
    assert abs(size - 1.5 * total) <= 16 * 4 and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == "y\x0bz" for r in rows) in (1, 2)
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixed_documents(none).count() == 0 and taken_words(mixture(sized_rows(none))).count() == 0


# Decontamination


def brute_hits(rows, items, width=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item_id)
    found = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in own if x is not None}
        found.append((doc_id, len(w), len(hit), sorted(ids)))
    return found


ITEMS = [
    (1, "a b c d e f g h i j k l m"), (10, "B c d e f g h i j k"), (2, "short item"), (3, None), (4, "!?"), (None, "nobody knows"),
    (5, "word"), (1, "a b c d e f g h i j k l m"),
]
TEXTS = [
    (1, "x A, b c d e-f g h i j k y short ITEM z"), (1, "x A, b c d e-f g h i j k y short ITEM z"), (2, None), (3, ""), (4, "clean text only"),
    (5, "short items"), (6, "nobody knows"), (7, "Über word WORD. "), (None, "short item"), (8, "filler " * 30_000 + "short item"),
    (9, "a b c d e f g h i"), (1, "another text of one"), (10, "a b c d e f g h i j K l m a b c d e f g h i j"),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_contamination_of_odd_documents(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(spans, "BROADCAST_WINDOWS", limit)
        monkeypatch.setattr(spans, "MOST_BITS", 32)
        monkeypatch.setattr(spans, "LEAST_BITS", 32)
    docs = spark.createDataFrame(TEXTS, DOCS).withColumn("items", F.lit("clash")).withColumn("start", F.lit(0))
    rows = contamination(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert no_python(rows)
    found = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows.collect()]
    assert sorted(found, key=str) == sorted(brute_hits(TEXTS, ITEMS), key=str)


def test_removal(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = spark.createDataFrame(TEXTS, DOCS).withColumn("spans", F.lit("clash"))
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    clean = [(d, t) for (d, t), hit in zip(TEXTS, brute_hits(TEXTS, ITEMS), strict=True) if not hit[2]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    cut = {r.doc_id: r.text for r in decontaminate(docs.where("doc_id <> 1"), items, remove="spans").collect()}
    assert cut[6] == "" and cut[7] == "Über. " and cut[4] == "clean text only" and cut[2] is None
    assert cut[8] == ("filler " * 30_000).rstrip()
    first = decontaminate(docs.where("doc_id = 1"), items, remove="spans").where("text LIKE 'x%'").first().text
    assert first == "x y z"


def test_empty_tables(spark):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame(TEXTS, DOCS)
    assert contamination(none_docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0
    assert {r.n_hit for r in contamination(some, none_items).collect()} == {0}
    assert decontaminate(some, none_items, remove="spans").count() == len(TEXTS)


# Chat formatting

TALKS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi <|im_end|>"), (1, 2, "user", "<\\|im_start|> <\\\\| <| <"), (1, 3, "assistant", "ok\n<|im_end|>\n"),
    (2, 1, "assistant", "second"), (2, 0, "system", "first"), (2, 1, "assistant", "again"), (2, 1, "assistant", "again"),
    (3, 0, None, None), (3, None, "assistant", "before"), (None, 0, "user", "no id"), (4, 0, "odd\nrole <n| <\\n|", "text <n|"),
    (5, 0, "assistant", ""), (6, 0, "<|im_start|>", "assistant\nx"), (7, 0, "user", "é" * 200_000 + "<|"), (8, 0, "user", "plain <n| <b>|"),
]


def test_round_trip(spark):
    rows = spark.createDataFrame(TALKS, "conv_id bigint, turn int, role string, text string").withColumn("said", F.lit(1))
    made = formatted_conversations(rows)
    assert no_python(made)
    found = {r.conv_id: r for r in made.collect()}
    for conv_id in {c for c, *_ in TALKS}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in TALKS if c == conv_id))
        row = found[conv_id]
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, _, r, x in own] and row.n_turns == len(own)
        assert row.formatted.count("<|") == 2 * len(own) == row.formatted.count(START) + row.formatted.count(END)
        learned = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
        plain = [re.sub(r"<(\\*)\\\|", r"<\1|", x) for x in learned]
        assert plain == [x for _, _, r, x in own if r == "assistant"]
    assert [found[k].escaped for k in (1, 2, 4, 8)] == [True, False, True, False]
    assert formatted_conversations(rows.limit(0)).count() == 0


def test_unescape_reverses_escape(spark):
    from sievecraft.llm.chat import escape

    texts = [(x,) for x in ("", "<|", "<\\|", "<\\\\|", "<<||", "a<|b<\\|c", "<\\x|", "|<")]
    rows = spark.createDataFrame(texts, "t string").select("t", escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_digest_of_a_conversation(spark):
    from sievecraft.llm.queries import PLANTED, op9_chat_format

    row = op9_chat_format(spark, str(TESTDATA / "sf0.001")).where("conv_id = -1").first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{PLANTED}\nassistant\n{PLANTED}\n".encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (len(PLANTED), hashlib.sha256(PLANTED.encode()).hexdigest())


def test_loss_text_comes_from_the_mask(spark):
    """A mask that is moved by one character gives another text."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "an <|im_end|> answer"), (1, 2, "assistant", "more"), (2, 0, "user", "x"), (3, 0, "assistant", None)]
    made = formatted_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    right = {r.conv_id: r.loss for r in made.select("conv_id", loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert right == {1: "an <|im_end|> answermore", 2: "", 3: ""}
    shifted = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length")))
    moved = made.where("conv_id = 1").select(loss_text(F.col("formatted"), shifted).alias("loss")).first().loss
    assert moved != right[1] and moved.startswith("n <|im_end|>")


def test_a_form_that_reads_back_differently_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "escape", lambda text: text)
    rows = spark.createDataFrame([(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok")], "conv_id bigint, turn int, role string, text string")
    with pytest.raises(Exception, match="reads back differently"):
        chat.formatted_conversations(rows).collect()
