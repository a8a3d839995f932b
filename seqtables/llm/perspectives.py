"""Operator 2: chat formatting by rotating the perspective, DataFrame functions only.

Every participant of a dialogue gets a rendering of it in which their own turns are the
assistant's, all others are named users, and only the assistant's turns are trained on. Context
turns (``system``) keep their role and have no perspective of their own.

A rendering is one row, or several parts of at most ``PART_TURNS`` turns in order, so no row grows
with the dialogue. Ranks come from a range partitioning of all turns, so a dialogue may span any
number of tasks; turns are gathered by part before they meet the participants.

Defined results: turns are ordered by turn number, speaker and text, nulls first, and repeated turns
are kept; a null text is empty; a null speaker is an unnamed user and no perspective; turns
with a null dialogue id form one dialogue; a dialogue without participants gives no row; other columns
are ignored. Spans are code points of the part's text, the end exclusive; they cover a trained turn's
content and its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.operators.ranking import grouped_row_number

PART_TURNS = 256
CONTEXT = ("system",)
# The marks around a turn.
BEGIN, NAME, BODY, END = "<|im_start|>", " name=", "\n", "<|im_end|>"
AFTER = "\n"


def rendered(messages: Column, perspective: Column, context=CONTEXT) -> Column:
    """Array of ``(head, body, tail, train)`` for the turns of a part."""

    def one(m: Column) -> Column:
        own = m["speaker"].eqNullSafe(perspective)
        role = (
            F.when(own, "assistant")
            .when(m["speaker"].isin(*context), m["speaker"])
            .otherwise("user")
        )
        named = ~own & m["speaker"].isNotNull() & ~m["speaker"].isin(*context)
        label = F.when(named, F.concat(F.lit(NAME), m["speaker"])).otherwise("")
        return F.struct(
            F.concat(F.lit(BEGIN), role, F.coalesce(label, F.lit("")), F.lit(BODY)).alias("head"),
            F.concat(m["content"], F.lit(END)).alias("body"),
            F.lit(AFTER).alias("tail"),
            own.alias("train"),
        )

    return F.transform(messages, one)


def train_spans(lines: Column) -> Column:
    """Array of ``(start, end)`` of the trained bodies."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, line: Column) -> Column:
        start = state["at"] + F.length(line["head"])
        end = start + F.length(line["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.length(line["tail"])).alias("at"),
            F.when(line["train"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(lines, start, step)["spans"]


def rotate_perspectives(
    turns: DataFrame,
    dialogue: str,
    turn: str,
    speaker: str,
    text: str,
    context=CONTEXT,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """``(dialogue, perspective, part, n_turns, text, spans)`` for each participant."""
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(dialogue).cast("string")), F.lit("")).alias("key"),
        F.col(dialogue).alias("dialogue"),
        F.col(turn).alias("turn"),
        F.col(speaker).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    placed = grouped_row_number(rows, ["key"], ["turn", "speaker", "content"], "pos")
    message = F.struct("pos", "speaker", "content")
    gathered = (
        placed.groupBy("key", F.floor(F.col("pos") / part_turns).cast("int").alias("part"))
        .agg(
            F.first("dialogue").alias("dialogue"),
            F.array_sort(F.collect_list(message)).alias("messages"),
        )
    )
    people = (
        rows.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*context))
        .select("key", F.col("speaker").alias("perspective"))
        .distinct()
    )
    lines = gathered.join(people, "key").select(
        "dialogue",
        "perspective",
        "part",
        F.size("messages").cast("long").alias("n_turns"),
        rendered(F.col("messages"), F.col("perspective"), context).alias("lines"),
    )
    joined = F.transform("lines", lambda m: F.concat(m["head"], m["body"], m["tail"]))
    return lines.select(
        "dialogue",
        "perspective",
        "part",
        "n_turns",
        F.array_join(joined, "").alias("text"),
        train_spans(F.col("lines")).alias("spans"),
    )
