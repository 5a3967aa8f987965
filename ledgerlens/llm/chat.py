"""Chat formatting with Spark expressions only.

A conversation's turns are collected and sorted; a turn with the role of the one
before continues its block; blocks are joined to one text:

    <|turn|>role<|text|>text<|next|>text of the same role<|turn|>role<|text|>...<|end|>

A "<|" inside a role or text is written "<|'", which no marker begins with, so
reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
OPEN, GUARD = "<|", "<|'"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(GUARD))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(GUARD), F.lit(OPEN))


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, n_blocks, loss): ``loss`` lists {start, length} of trained texts in ``formatted``, in code points.

    Rows go by turn, then role, then text; null turns come first. A null text or
    role counts as empty; a null conv_id is a conversation of its own; repeated
    rows are turns of their own; other columns are ignored. A conversation is one
    text, so its turns meet in one row by nature.
    """
    turns = rows.select(
        "conv_id", F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def opening(t, i):
        before = F.when(i > 0, F.get(F.col("t"), i - 1)["role"])
        goes_on = F.coalesce(before == t["role"], F.lit(False))
        return F.when(goes_on, F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)))

    parts = sorted_.select("conv_id", F.transform("t", lambda t, i: F.struct(
        opening(t, i).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained_role).alias("loss"))).alias("parts"))
    walked = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return parts.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.size(F.filter("parts", lambda p: p["head"] != NEXT)).cast("long").alias("n_blocks"), walked.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of {role, text}, read back from a formatted conversation."""
    body = F.substring(formatted, F.lit(len(TURN) + 1), F.length(formatted) - len(TURN) - len(END))
    blocks = F.split(body, F.lit("<\\|turn\\|>"), -1)

    def of_block(block):
        cut = F.split(block, F.lit("<\\|text\\|>"), -1)
        role = unescape(F.get(cut, F.lit(0)))
        return F.transform(F.split(F.get(cut, F.lit(1)), F.lit("<\\|next\\|>"), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The trained texts, cut out of a formatted conversation by its mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
