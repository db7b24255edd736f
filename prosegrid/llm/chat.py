"""Chat formatting with Spark expressions only.

A conversation becomes one string. Turns are sorted, adjacent turns of one role are merged into
one block, and blocks are concatenated:

    <|turn|>ROLE<|says|>TEXT<|also|>TEXT<|done|>

``<|also|>`` parts the turns that a block merges, so the turns can be read back. Inside roles and
texts a backslash is doubled and every control string gets a backslash after its first character,
so that no control string of this or of other common templates is left in a text; taking away
each escaping backslash gives the text back.

Defined results: a null text or role is empty; a null turn sorts first; turns with equal numbers
sort by role, then text; a row with a null conversation id is a conversation of its own, so that
such rows never gather; repeated rows are turns of their own; an empty table gives an empty result.
Other columns are ignored. A conversation is a row, so it must fit one; spans are sums over its
rows, so its cost is that of a sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, ALSO, DONE = "<|turn|>", "<|says|>", "<|also|>", "<|done|>"

#: Control strings of this template and of other common ones.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to conv_id, formatted and loss_spans.

    loss_spans are (start, length) in code points of ``formatted``, one for each assistant turn.
    """
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    row = F.struct(F.col("turn").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    key = ["conv_id", "_alone"]
    sorted_turns = turns.select("conv_id", alone.alias("_alone"), row.alias("_row")).groupBy(key).agg(F.sort_array(F.collect_list("_row")).alias("turns"))
    # A block is the turns from where a role begins to where another does.
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = sorted_turns.select(*key, "turns", begins.alias("begins"))
    until = lambda k: F.coalesce(F.get("begins", k + 1), F.size("turns"))
    blocks = F.transform("begins", lambda b, k: F.struct(F.get("turns", b)["role"].alias("role"), F.transform(F.slice("turns", b + 1, until(k) - b), lambda t: t["text"]).alias("texts")))
    merged = cut.select(*key, F.posexplode(blocks).alias("block", "b")).select(*key, "block", "b.role", F.size("b.texts").alias("n"), F.posexplode("b.texts").alias("at", "text"))
    # What a text adds to the string: what opens it, itself, and at its block's end what closes that.
    opens = F.when(F.col("at") == 0, F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))).otherwise(F.lit(ALSO))
    closes = F.when(F.col("at") == F.col("n") - 1, DONE).otherwise("")
    pieces = merged.select(*key, "block", "at", (F.col("role") == "assistant").alias("loss"), opens.alias("opens"), escaped(F.col("text")).alias("text"), closes.alias("closes"))
    length = lambda c: F.char_length(c)
    order = Window.partitionBy(*key).orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length("opens") + length("text") + length("closes")).over(order), F.lit(0))
    placed = pieces.withColumn("start", (before + length("opens") + 1).cast("int"))
    span = F.when(F.col("loss"), F.struct("start", length("text").alias("length")))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", F.concat("opens", "text", "closes").alias("part"))))
    whole = placed.groupBy(key).agg(parts.alias("parts"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return whole.select("conv_id", F.array_join("parts.part", "").alias("formatted"), "loss_spans")


def read_chats(chats: DataFrame) -> DataFrame:
    """What format_chats wrote, to conv_id, turns (role, text) and loss_texts (each unescaped)."""
    blocks = F.filter(F.split("formatted", re.escape(TURN)), lambda block: block != "")

    def turns_of(block: Column) -> Column:
        role = unescaped(F.substring_index(block, SAYS, 1))
        body = F.substring_index(F.substring_index(block, SAYS, -1), DONE, 1)
        texts = F.split(body, re.escape(ALSO), -1)
        return F.transform(texts, lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    return chats.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"], s["length"]))).alias("loss_texts"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
