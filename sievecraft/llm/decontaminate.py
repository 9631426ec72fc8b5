"""Finding passages of a benchmark in documents, and removing them.

Hashes of the benchmark's windows of consecutive words fill a table of bits, a constant of
the plan. Every window of every document is looked up in it by a hash of its lower-cased words,
inside the row of the document. What that lets pass is joined by its words with the windows
themselves, which are broadcast while they are few. So texts are never repeated or shuffled,
and only places that may be hits leave a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import MERGED_PLACES, ascii_lower, spaced_words, word_count, word_list

#: Windows that may be broadcast: at 10 words each, some 30 MB. More of them are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Bits of the table for each window, and the least and most bits. A fuller table lets more places pass, no fewer.
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 22


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` and ``spans`` for every row of ``docs`` (``doc_id``, ``text``).

    A window is ``width`` consecutive words of an item of ``benchmark`` (``item_id``, ``text``), or all words
    of a shorter item. ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the ids
    of the items with an occurring window as sorted strings, and ``spans`` the merged hit places (``start``,
    ``stop``, in words from 0). Words are compared with A-Z lower-cased. A null or empty text has no words;
    items without words have no windows, those without id hit words but are not listed. Repeated rows give
    the same result once per row; an empty benchmark hits nothing.
    """
    hits = _hits(docs, benchmark, width)
    sized = docs.select("doc_id", _text_hash().alias("text_hash"), word_count(spaced_words(F.col("text"))).alias("n_words"))
    found = hits.select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"), "items", "spans")
    joined = sized.join(
        found, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash")), "left"
    )
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the words of the hit spans.

    All columns stay. With spans, a hit word goes with the separators before it, and other texts stay
    exactly as they are. Nulls, repeated rows and empty tables are handled as in ``contamination``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    hits = _hits(docs, benchmark, width).select(
        F.col("doc_id").alias("__own"), F.col("text_hash").alias("__own_hash"), F.col("spans").alias("__spans")
    )
    same = docs["doc_id"].eqNullSafe(F.col("__own")) & (F.xxhash64(docs["text"]) == F.col("__own_hash"))
    if remove == "documents":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left")
    kept = F.concat(
        F.expr(
            r"array_join(filter(regexp_extract_all(text, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
            r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0), "
            r"(w, i) -> NOT exists(__spans, s -> s.start <= i AND i < s.stop)), '')"
        ),
        F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0),
    )
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)


def _text_hash() -> Column:
    return F.xxhash64("text")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """The distinct windows: ``lookup`` (hash), ``window`` (its words), ``length`` and ``item_ids``."""
    spaced = benchmark.select(F.col("item_id").cast("string").alias("item_id"), spaced_words(F.col("text")).alias("spaced"))
    items = spaced.withColumn("words", word_list(F.col("spaced"))).where(F.size("words") > 0)
    lengths = items.withColumn("length", F.least(F.size("words"), F.lit(width)))
    placed = lengths.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    taken = F.slice("words", F.col("at"), F.col("length"))
    return (
        placed.select("item_id", "length", ascii_lower(F.array_join(taken, " ")).alias("window"), taken.alias("taken"))
        .groupBy("window", "length")
        .agg(F.array_compact(F.collect_set("item_id")).alias("item_ids"), F.first("taken").alias("taken"))
        .withColumn("hashes", _word_hashes(F.col("taken")))
        .select(
            F.coalesce(
                *(F.when(F.col("length") == n, _window_hash(F.lit(0), n)) for n in range(1, width + 1))
            ).alias("lookup"),
            "window",
            "length",
            "item_ids",
        )
    )


def _word_hashes(words: Column) -> Column:
    """Hashes that agree for words equal but for case."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _window_hash(start: Column, length: int) -> Column:
    """Of ``length`` items of ``hashes``, read one by one: a slice would copy the whole array each time."""
    return F.xxhash64(*(F.get("hashes", start + k) for k in range(length)))


def _hits(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """``items`` and merged ``spans`` of each (doc_id, text_hash) with a hit."""
    windows = benchmark_windows(benchmark, width)
    counted = windows.groupBy("length").count().collect()  # at most ``width`` rows
    lengths, total = sorted(row["length"] for row in counted), sum(row["count"] for row in counted)
    passes = _bit_table(windows, total)
    words = docs.select("doc_id", _text_hash().alias("text_hash"), word_list(spaced_words(F.col("text"))).alias("words"))
    hashed = words.withColumn("hashes", _word_hashes(F.col("words")))

    def places(length: int) -> Column:
        """Starts of windows of this length that pass the bits."""
        starts = F.sequence(F.lit(0), F.size("hashes") - length)
        lookups = F.when(F.size("hashes") >= length, F.transform(starts, lambda i: _window_hash(i, length)))
        return F.array_compact(F.transform(lookups, lambda h, i: F.when(passes(h), i)))

    columns = {f"places{n}": places(n) for n in lengths}
    found = [_each_window(f"places{n}", n) for n in lengths]
    nothing = F.array().cast("array<struct<start:int,stop:int,window:string>>")
    placed = hashed.withColumns(columns).select(
        "doc_id", "text_hash", F.concat(*(F.coalesce(x, nothing) for x in found), nothing).alias("maybe")
    )
    # Outer, as Spark would repeat the whole computation of the array in a filter for non-empty ones.
    spread = placed.select("doc_id", "text_hash", F.explode_outer("maybe").alias("m")).select("doc_id", "text_hash", "m.*")
    known = windows.select("window", "item_ids")
    verified = spread.join(F.broadcast(known) if total <= BROADCAST_WINDOWS else known, "window")
    grouped = verified.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("places"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )
    return grouped.select("doc_id", "text_hash", "items", F.expr(MERGED_PLACES).alias("spans"))


def _each_window(starts: str, length: int) -> Column:
    """The windows of ``words`` at these starts."""

    def window(start: Column) -> Column:
        taken = F.transform(F.sequence(start, start + (length - 1)), lambda k: F.get("words", k))
        stop = (start + length).cast("int").alias("stop")
        return F.struct(start.cast("int").alias("start"), stop, ascii_lower(F.array_join(taken, " ")).alias("window"))

    return F.transform(starts, window)


def _bit_table(windows: DataFrame, total: int):
    """A test of a window's hash that holds for all hashes of ``windows``, and for few others."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_WINDOW * total).bit_length()))
    word = F.pmod(F.col("lookup"), F.lit(size)).cast("long")
    filled = windows.select(F.shiftright(word, 5).alias("at"), F.expr("shiftleft(1L, CAST(pmod(lookup, 32) AS INT))").alias("bit"))
    table = [0] * (size >> 5)
    for row in filled.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most size / 32 rows
        table[row["at"]] = row["bits"]
    # Written as text, the table is one constant for the planner.
    bits = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def passes(lookup: Column) -> Column:
        place = F.pmod(lookup, F.lit(size))
        return F.getbit(F.get(bits, F.shiftright(place, 5).cast("int")), F.pmod(lookup, F.lit(32)).cast("int")) == 1

    return passes
