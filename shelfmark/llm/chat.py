"""Chat formatting with DataFrame functions only: one text per conversation, and one training
example per assistant turn, whose context is everything before it.

A turn is ``### role: text</turn>`` and a line break. Inside roles and texts a backslash becomes
``\\b``, a ``#`` becomes ``\\h``, and the slash of ``</`` becomes ``\\s``; in roles a colon becomes
``\\c``. So neither control string can stand in an escaped text, and replacing back gives the
text again: after escaping, each backslash begins one of these pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = "### "
COLON = ": "
END = "</turn>\n"
TRAINED_ROLE = "assistant"

_TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("</", "<\\s"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped_text(text: Column) -> Column:
    return _replaced(text, _TEXT_ESCAPES)


def escaped_role(role: Column) -> Column:
    return _replaced(role, _ROLE_ESCAPES)


def unescaped(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(_ROLE_ESCAPES)])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, and ``spans``, the places of the
    assistant's texts in it (code points from 0, end exclusive, in order).

    ``turns`` has conv_id, turn, role and text. Null roles and texts are empty; turns go by
    (turn, role, text), nulls first, so ties and repeated rows have a fixed place; rows with a
    null conv_id are one conversation. An empty table gives no rows; other columns are ignored.
    A conversation is one text, so its turns meet in one row.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escaped_text(F.col("text"))
    rows = (
        rows.withColumn("number", F.row_number().over(in_order))
        .withColumn("body", body)
        .withColumn("segment", F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(COLON), F.col("body"), F.lit(END)))
        .withColumn("until", F.sum(F.length("segment").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    end = F.col("until") - len(END)
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "number",
                    "segment",
                    (end - F.length("body")).alias("start"),
                    end.alias("end"),
                    (F.col("role") == TRAINED_ROLE).alias("trained"),
                )
            )
        ).alias("turns")
    )
    trained = F.filter("turns", lambda t: t["trained"])
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform(trained, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("spans"),
    )


def prefix_targets(formatted: DataFrame) -> DataFrame:
    """One training example per assistant turn: ``conv_id``, ``example`` (from 0), ``context``
    (all of the formatted text before the reply) and ``target`` (the reply, escaped), of which
    only the target is trainable. Conversations without an assistant turn give no example."""
    replies = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("target"),
        ),
    )
    return (
        formatted.withColumn("replies", replies)
        .select("conv_id", "formatted", F.posexplode("replies").alias("example", "reply"))
        .select(
            "conv_id",
            "example",
            F.substring("formatted", F.lit(1), F.col("reply.start").cast("int")).alias("context"),
            F.col("reply.target").alias("target"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text again, as an array of (role, text)."""
    segments = F.split(formatted, END)
    segments = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def parts(segment: Column) -> Column:
        colon = F.instr(segment, COLON)
        role = F.substring(segment, F.lit(len(HEAD) + 1), colon - (len(HEAD) + 1))
        text = F.substring(segment, colon + len(COLON), F.length(segment))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(segments, parts)
