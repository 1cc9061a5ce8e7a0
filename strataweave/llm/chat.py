"""Chat formatting with a grammar round trip, in SQL functions only.

A conversation becomes, turn after turn, ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.
A deterministic parser (split at the start mark, role up to the first line
break, text up to the first end mark, which one line break must follow) reads
the rendering back. Where what it recovers is not the source, the turns that
conflict on their own are escaped and the conversation is parsed again; where
that isn't identical either, every turn is escaped.

Escaping puts a backslash between ``<`` and ``|`` (and one more wherever there
are some already); in roles a line break also becomes ``<|nl|>``. After that no
``<|`` is left, and the parser takes one backslash away again, so any text
comes back exactly.

Defined results
- A null text or role is the empty string; a null conversation id is a
  conversation of its own.
- Turns go by turn, then role, then text; repeated rows are repeated turns.
- An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _escaped_turn(t: Column) -> Column:
    return F.struct(F.replace(_escaped(t.role), F.lit("\n"), F.lit(BREAK)).alias("role"), _escaped(t.text).alias("text"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendering; a text is null where the grammar is broken."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece))
        text = F.substring_index(body, END, 1)
        sound = piece == F.concat(role, F.lit("\n"), text, F.lit(END + "\n"))
        return F.struct(
            _unescaped(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"),
            F.when(sound, _unescaped(text)).alias("text"),
        )

    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_chats(rows: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_runs, escaped_turns for rows (conv_id, turn, role, text).

    ``loss_runs`` has for each turn the code points to skip, those of its text,
    and whether the loss counts on them; the runs end with the closing mark.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    grouped = (
        rows.select("conv_id", "turn", text("role"), text("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("sorted"))
        .select("conv_id", F.transform("sorted", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    )
    first = grouped.withColumn("plain", _render(F.col("turns"))).withColumn("same", parse(F.col("plain")).eqNullSafe(F.col("turns")))
    conflicts = lambda t: ~parse(_render(F.array(t))).eqNullSafe(F.array(t))
    second = first.withColumn("some", F.when(F.col("same"), F.col("turns")).otherwise(F.transform("turns", lambda t: F.when(conflicts(t), _escaped_turn(t)).otherwise(t))))
    third = second.withColumn("sound", F.col("same") | parse(_render(F.col("some"))).eqNullSafe(F.col("turns")))
    final = third.withColumn("written", F.when(F.col("sound"), F.col("some")).otherwise(F.transform("turns", _escaped_turn)))
    return final.select(
        "conv_id",
        F.when(F.col("same"), F.col("plain")).otherwise(_render(F.col("written"))).alias("formatted"),
        F.zip_with(
            "turns",
            "written",
            lambda source, t: F.struct(
                (F.length(t.role) + len(START) + 1).alias("skip"),
                F.length(t.text).alias("take"),
                (source.role == trained_role).alias("loss"),
            ),
        ).alias("loss_runs"),
        F.size(F.filter(F.zip_with("turns", "written", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)).alias("escaped_turns"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns and the unescaped text under the loss mask, from the output alone."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    under = F.zip_with(pieces, "loss_runs", lambda p, run: F.when(run.loss, _unescaped(F.substring(p, run.skip - len(START) + 1, run.take))).otherwise(""))
    return chats.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
