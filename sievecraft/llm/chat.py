"""Conversations as marked-up text that a parser turns back into the same conversation.

    <|im_start|>role
    text<|im_end|>

A control string begins with ``<|``. Where role or text hold ``<``, any backslashes and ``|``, the
escaped form has one backslash more, so it holds no control string, and the parser takes one away.
Line feeds in a role are written ``<n|`` behind a backslash in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"

_TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
_TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    # A line feed becomes "<n|"; what looks like one already gets a backslash.
    return escape(F.replace(F.regexp_replace(role, r"<(\\*)n\|", r"<$1\\n|"), F.lit("\n"), F.lit("<n|")))


def _plain_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(unescape(role), F.lit("<n|"), F.lit("\n")), r"<(\\*)\\n\|", r"<$1n|")


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of turns (role, text)."""

    def piece(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        if escaped:
            role, text = _escaped_role(role), escape(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, piece), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.zip_with(
        roles, texts, lambda role, text: F.struct(_plain_role(role).alias("role"), unescape(text).alias("text"))
    )


def well_formed(formatted: Column, n_turns: Column) -> Column:
    """Whether control strings stand at the marks of ``n_turns`` turns only."""
    openings = F.length(formatted) - F.length(F.replace(formatted, F.lit("<|"), F.lit("")))
    return openings == 4 * n_turns


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``formatted``, ``escaped``, ``turns`` and ``loss_spans`` for every conversation.

    ``rows`` holds ``conv_id``, ``turn``, ``role`` and ``text``; turns stand in ascending order, null first, ties by
    role and text. A null role or text is empty, a null conv_id is a conversation of its own; repeated rows are
    repeated turns; other columns are not read. ``turns`` is what the parser makes of ``formatted``. Texts are
    first rendered as they are; where that holds a control string too many or the parser's turns differ
    from the source, conflicting content is escaped (``escaped``) and the escaped form is parsed and compared in turn; a
    difference that remains is an error. ``loss_spans`` (``start``, ``length``, in code points) are the places of
    the assistant's texts in ``formatted``, as written there.

    A conversation's text is one value of one row, so it must stay under Spark's 2 GB for a row.
    """
    empty = F.lit("")
    said = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))
    source = grouped.select(
        "conv_id", F.transform("said", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("source")
    )
    plain = source.withColumn("plain", render(F.col("source"), escaped=False))
    tried = plain.withColumn(
        "escaped",
        ~(well_formed(F.col("plain"), F.size("source")) & parse(F.col("plain")).cast(_TURNS).eqNullSafe(F.col("source").cast(_TURNS))),
    )
    written = tried.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("source"), escaped=True)).otherwise(F.col("plain"))
    )
    read = written.withColumn("turns", parse(F.col("formatted")))
    agrees = F.col("turns").cast(_TURNS).eqNullSafe(F.col("source").cast(_TURNS))
    return read.select(
        "conv_id",
        F.size("source").cast("long").alias("n_turns"),
        "formatted",
        "escaped",
        F.when(agrees, F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation reads back differently"))).alias("turns"),
        F.expr(_SPANS).alias("loss_spans"),
    )


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """What stands under the loss mask, unescaped, one span after the other."""
    cut = F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")


#: Places of the assistant's texts, from the lengths of the written pieces.
_SPANS = rf"""
    aggregate(
        regexp_extract_all(formatted, '{_TURN.replace(chr(92), chr(92) * 2)}', 0),
        named_struct('at', 0L, 'spans', CAST(array() AS array<struct<start:bigint,length:bigint>>)),
        (done, piece) -> named_struct(
            'at', done.at + length(piece),
            'spans', CASE WHEN startswith(piece, '{START}assistant\n')
                THEN concat(done.spans, array(named_struct(
                    'start', done.at + {len(START) + len("assistant") + 1},
                    'length', CAST(length(piece) - {len(START) + len("assistant") + 1 + len(END) + 1} AS bigint))))
                ELSE done.spans END),
        done -> done.spans
    )
"""
