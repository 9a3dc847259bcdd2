"""Places in an order over a whole table, found by many tasks.

Rows are dealt by ranges of the order, sorted inside their task and written with their place
there; what comes before a task is the sum of the sizes of the tasks before it, one number
per task. Rows that tie on every column are split as well, so no key is too large for a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import literal_array, shuffle_slots, write_table

#: Fixed value: bits that ``monotonically_increasing_id`` leaves for the rows of one partition.
ROW_BITS = 33


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the place of each row, from 0, under ``order``; rows that tie come in any order.

    Runs one job that writes the sorted table, and one that counts its rows per task.
    """
    slots = shuffle_slots(df.sparkSession)
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    placed = keyed.repartitionByRange(slots, *keys).sortWithinPartitions(*keys).drop("_tie")
    table = write_table(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", ROW_BITS)
    sizes = {r.part: r.n for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)]
    before = literal_array([0, *accumulate(counts)][:-1] or [0], "bigint")
    place = F.get(before, part.cast("int")) + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return table.withColumn(name, place).drop("_at")
