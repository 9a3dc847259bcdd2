"""Perspective rotation of conversations, in column expressions only.

Every participant becomes the assistant once: the dialogue is rendered with that speaker's
turns under the assistant's name, all others as named users, and a mask that covers what the
assistant says. A rendered text covers up to ``part_turns`` turns, so a conversation of any
length becomes rows of bounded size.

Turns get their position by rank: ranges of (conversation, turn) go to tasks, each task counts
its own turns, and a running sum over tasks joins the counts. So a conversation that holds a
third of all turns is ranked by many tasks. The rows then meet the participants of
their conversation in an equality join, whose skewed keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of
from tilewright.session import shuffle_slots, write_table

#: Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``position`` from 0 in each conversation.

    Turns of one number are ordered by role and then by the md5 of their text.
    """
    order = ["turn", "role", "tie"]
    keyed = turns.withColumn("tie", F.md5(F.col("text").cast("binary")))
    dealt = keyed.repartitionByRange(shuffle_slots(turns.sparkSession), "conv_id", *order)
    dealt = write_table(dealt.withColumn("task", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("task", "conv_id").orderBy(*order)
    local = dealt.withColumn("here", F.row_number().over(here))
    placed = local.join(counts, (F.col("task") == F.col("t")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return placed.select("conv_id", "turn", "role", "text", (F.col("before") + F.col("here") - 1).alias("position"))


def message(speaker: Column, text: Column) -> Column:
    """One rendered message: its head, and its body with the end mark. Marks inside texts and names are broken up."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.struct(
        F.concat(F.lit(START), safe(speaker), F.lit("\n")).alias("head"),
        F.concat(safe(text), F.lit(END)).alias("body"),
    )


def rotate(
    conversations: DataFrame, part_turns: int = 64, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation, participant and part of ``part_turns`` turns.

    Columns: conv_id, perspective (the participant), part (from 0), n_turns, text, and mask, the list of
    (start, stop) in code points of what the assistant is to learn, end marks included.
    Every role but ``system`` takes part; system turns stay system turns. A null role counts
    as "unknown", a null text as empty, a null turn comes first, turns of the null id are one
    conversation, and repeated rows are turns of their own. A conversation without
    participants gives no row. Other columns are ignored.
    """
    columns_of(conversations, id_col, turn_col, role_col, text_col)
    turns = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    people = turns.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective"))
    people = write_table(people.distinct(), "participants")
    placed = ranked_turns(turns)
    seen = placed.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("role") == F.col("perspective")
    named = F.concat(F.lit("user name="), F.regexp_replace("role", r"\s", "_"))
    speaker = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise(named)
    said = seen.select(
        "conv_id",
        "perspective",
        F.floor(F.col("position") / part_turns).alias("part"),
        F.struct("position", own.alias("own"), message(speaker, F.col("text")).alias("m")).alias("said"),
    )
    parts = said.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    length = lambda s: F.length(s["m"]["head"]) + F.length(s["m"]["body"])
    walked = F.aggregate(
        "said",
        F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda acc, s: F.struct(
            (acc["at"] + length(s)).alias("at"),
            F.when(
                s["own"],
                F.concat(
                    acc["mask"],
                    F.array(F.struct((acc["at"] + F.length(s["m"]["head"])).alias("start"), (acc["at"] + length(s)).alias("stop"))),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    text = F.array_join(F.transform("said", lambda s: F.concat(s["m"]["head"], s["m"]["body"])), "")
    return parts.select(
        "conv_id", "perspective", "part", F.size("said").alias("n_turns"), text.alias("text"), walked["mask"].alias("mask")
    )
