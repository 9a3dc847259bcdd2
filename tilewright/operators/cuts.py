"""Choosing among legal cuts: best scored, random, shifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import toss
from tilewright.operators.layout import LAYOUT_KEY


def best_cut(scored: DataFrame) -> DataFrame:
    """Per layout, the legal cut with the highest score; the lowest action wins a tie."""
    best = F.max_by(F.struct("action", "score"), F.struct(F.col("score"), -F.col("action")))
    return scored.filter("legal").groupBy(LAYOUT_KEY).agg(best.alias("b")).select(LAYOUT_KEY, "b.*")


def random_cut(cuts: DataFrame, seed: int) -> DataFrame:
    """Per layout, one of its cuts, fixed by the seed."""
    pick = F.min_by("action", F.struct(toss(seed, LAYOUT_KEY, "action"), "action"))
    return cuts.groupBy(LAYOUT_KEY).agg(pick.alias("action"))


def shifted_action(action: Column, shift: Column, nx: int, mode: str = "anchor") -> Column:
    """The action ``shift`` lines away.

    ``anchor`` moves a horizontal cut along its row and a vertical one along its
    column, which can only be legal in another partition. ``line`` moves the cut
    line itself.
    """
    horizontal = action % 2 == 0
    along_row, along_column = shift * 2, shift * 2 * nx
    if mode == "line":
        along_row, along_column = along_column, along_row
    return (action + F.when(horizontal, along_row).otherwise(along_column)).cast("int")


def shift_cut(cuts: DataFrame, chosen: DataFrame, k: int, nx: int, mode: str = "anchor") -> DataFrame:
    """(layout_id, action, shift, shifted) for each shift from -k to k but 0.

    ``shifted`` is the moved cut when it is among the layout's legal ``cuts``, else the chosen one.
    """
    steps = F.array(*[F.lit(s) for s in range(-k, k + 1) if s != 0])
    moved = chosen.select(LAYOUT_KEY, "action", F.explode(steps).alias("shift")).withColumn(
        "target", shifted_action(F.col("action"), F.col("shift"), nx, mode)
    )
    legal = cuts.select(LAYOUT_KEY, F.col("action").alias("target"), F.lit(True).alias("legal"))
    joined = moved.join(legal, [LAYOUT_KEY, "target"], "left")
    shifted = F.when(F.col("legal"), F.col("target")).otherwise(F.col("action"))
    return joined.select(LAYOUT_KEY, "action", "shift", shifted.alias("shifted"))
