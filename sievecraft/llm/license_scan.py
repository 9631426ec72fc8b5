"""License notices in texts, by ordered signature rules.

Everything happens inside one projection: nothing is shuffled, and a text is one row from
the scan to the result. A set of the text's words, intersected with the rules' keywords, gates
the patterns, so nearly all texts cost one pass over their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, Rule, rules
from .words import ascii_lower, spaced_words, word_count

#: Confidence of a detection by its tier.
WEIGHTS = {1: 1.0, 2: 0.8, 3: 0.4}

_FOUND = "start:int,stop:int,tier:int,order:int,label:string"


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """``doc_id``, ``n_words`` and the detections of every row of ``docs`` (``doc_id``, ``text``).

    ``base`` are all places of the base phrases, ``kept`` the detections of all rules that no other of the
    same or a higher priority contains; both are arrays of (start, stop, tier, order, label), in words from
    0, in order of their place. Of detections of one tier in the same place the first rule's stays.
    Texts that are null, empty or without a keyword have empty arrays. Repeated rows and ids are
    scanned each; other columns are not read.
    """
    signatures = rules() if signatures is None else signatures
    spaced = docs.select("doc_id", spaced_words(F.col("text")).alias("spaced"))
    keywords = F.array(*(F.lit(word) for word in sorted({rule.keyword for rule in signatures})))
    gated = spaced.withColumn("hits", F.array_intersect(F.split(F.lower("spaced"), " "), keywords))
    # In Spark a CASE evaluates its branch for the rows that take it only.
    found = F.when(F.size("hits") > 0, _detections(ascii_lower(F.col("spaced")), F.col("hits"), signatures))
    empty = F.array().cast(f"array<struct<{_FOUND}>>")
    detected = gated.withColumn("found", F.coalesce(found, empty))
    base = F.filter("found", lambda d: d["order"] < len(BASE))
    return detected.select(
        "doc_id", word_count(F.col("spaced")).alias("n_words"), base.alias("base"), _uncontained().alias("kept")
    )


def score(kept: Column) -> Column:
    """The confidence of the surest detection, 0 without one."""
    weight = lambda d: F.coalesce(*(F.when(d["tier"] == tier, F.lit(w)) for tier, w in WEIGHTS.items()))
    return F.coalesce(F.array_max(F.transform(kept, weight)), F.lit(0.0))


def label_list(*detections: Column) -> Column:
    """The distinct labels, sorted and joined by commas."""
    named = [F.transform(d, lambda x: x["label"]) for d in detections]
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*named))), ",")


def _detections(words: Column, hits: Column, signatures: list[Rule]) -> Column:
    table = F.array(
        *(
            F.struct(*(F.lit(value).alias(name) for name, value in rule._asdict().items()))
            for rule in signatures
        )
    )
    able = F.filter(table, lambda rule: F.array_contains(hits, rule["keyword"]))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    return F.array_sort(F.flatten(F.transform(able, lambda rule: _places(padded, rule))), _by_place)


def _by_place(a: Column, b: Column) -> Column:
    """Start first, then the longer, then the higher priority, then the earlier rule."""
    keys = [a["start"] - b["start"], b["stop"] - a["stop"], a["tier"] - b["tier"], a["order"] - b["order"]]
    return F.coalesce(*(F.when(key != 0, key) for key in keys), F.lit(0))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


def _places(padded: Column, rule: Column) -> Column:
    """All matches of a rule. A word's number is the count of spaces before it, less one."""
    matches = F.regexp_extract_all(padded, rule["pattern"], F.lit(0))
    pieces = F.split(padded, rule["pattern"])
    pairs = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(_spaces(p).alias("before"), _spaces(m).alias("inside")))
    begin = F.struct(F.lit(-1).alias("at"), F.array().cast(f"array<struct<{_FOUND}>>").alias("found"))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["before"]
        place = F.struct(
            start.alias("start"),
            (start + pair["inside"] + 1).alias("stop"),
            rule["tier"].alias("tier"),
            rule["order"].alias("order"),
            rule["label"].alias("label"),
        )
        return F.struct((start + pair["inside"]).alias("at"), F.concat(done["found"], F.array(place)).alias("found"))

    return F.aggregate(pairs, begin, add, lambda done: done["found"])


def _uncontained() -> Column:
    """In order of place, a detection is contained if one before it, of its tier or a higher one, ends no earlier."""
    tiers = sorted(WEIGHTS)
    begin = F.struct(
        *(F.lit(-1).alias(f"end{tier}") for tier in tiers), F.array().cast(f"array<struct<{_FOUND}>>").alias("kept")
    )

    def add(done: Column, d: Column) -> Column:
        reached = [F.when(d["tier"] >= tier, done[f"end{tier}"]) for tier in tiers]
        contained = F.greatest(F.lit(-1), *reached) >= d["stop"]
        return F.struct(
            *(
                F.when(d["tier"] == tier, F.greatest(done[f"end{tier}"], d["stop"])).otherwise(done[f"end{tier}"]).alias(f"end{tier}")
                for tier in tiers
            ),
            F.when(contained, done["kept"]).otherwise(F.concat(done["kept"], F.array(d))).alias("kept"),
        )

    return F.aggregate("found", begin, add, lambda done: done["kept"])
