"""Chat formatting: one training string for each conversation, with a loss mask, by Spark expressions only.

Template: each run of turns of one role becomes ``<s>role<r>text<p>text</s>``; ``<p>`` parts the texts that were
merged. Control strings inside roles and texts (those four, and ``[INST]`` and ``[/INST]``, which other templates
reserve) get a backslash after their first character, backslashes are doubled, and so the formatted string can be
parsed without doubt and gives every turn back. Loss falls on the texts of assistant turns.

A conversation is one row of the result by nature, so the turns of one conversation meet in one task; they are
sorted, merged and joined in time linear in their length (n log n for the sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, PART, CLOSE = "<s>", "<r>", "<p>", "</s>"
#: Between the first and the second character of a control string.
_INSIDE = r"(?<=<)(?=/?[srp]>)|(?<=\[)(?=/?INST\])"


def escaped(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), _INSIDE, r"\\")


def unescaped(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, segments (array of text and loss), formatted (the segments' texts joined).

    Turns are ordered by turn, then role, then text, nulls first; a null role or text is empty; repeated rows are
    turns of their own; a null conv_id is one conversation; an empty table gives an empty one. Other columns are
    not read.
    """
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    rows = rows.withColumn("starts", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role != get(t, i - 1).role)"))
    # A block for each start: its role and the texts up to the next start.
    rows = rows.select("conv_id", F.expr("transform(starts, (s, k) -> struct(t[s].role as role, transform(slice(t, s + 1, coalesce(get(starts, k + 1), size(t)) - s), x -> x.text) as texts))").alias("blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)

    def block(b: Column) -> Column:
        loss = b["role"] == loss_role
        parts = F.transform(b["texts"], lambda x, i: F.when(i == 0, F.array(segment(escaped(x), loss))).otherwise(F.array(segment(F.lit(PART), no), segment(escaped(x), loss))))
        return F.concat(F.array(segment(F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(ROLE_END)), no)), F.flatten(parts), F.array(segment(F.lit(CLOSE), no)))

    rows = rows.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
    return rows.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescaped(F.substring(F.split_part(b, F.lit(ROLE_END), F.lit(1)), len(OPEN) + 1, 2**31 - 1))
        return F.transform(F.split(F.split_part(b, F.lit(ROLE_END), F.lit(2)), PART), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_role: str = "assistant") -> Column:
    """All text of a formatted string under the loss mask, unescaped: what the turns of loss_role hold, in order."""
    return F.array_join(F.transform(F.filter(read_turns(formatted), lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
