"""Words of a text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sorted array ``places`` (start, stop), merged where they touch or overlap.
MERGED_PLACES = """
    aggregate(
        places,
        CAST(array() AS array<struct<start:int,stop:int>>),
        (done, p) -> CASE
            WHEN size(done) > 0 AND element_at(done, -1).stop >= p.start
            THEN concat(
                slice(done, 1, size(done) - 1),
                array(named_struct(
                    'start', element_at(done, -1).start,
                    'stop', greatest(element_at(done, -1).stop, p.stop)))
            )
            ELSE concat(done, array(named_struct('start', p.start, 'stop', p.stop)))
        END
    )
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """The words (digits, ASCII letters and everything beyond ASCII), one space apart, in their own case; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.trim(spaced)


def word_count(spaced: Column) -> Column:
    """The number of words of what ``spaced_words`` returns."""
    spaces = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def word_list(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def text_size(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
