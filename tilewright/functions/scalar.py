"""Row-level column functions. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRES_PER_DEGREE = 110000.0
PRIORITY_FLOOR = 1e-4
PRIORITY_POWER = 0.6
ABORTED_REWARD = 0.2
ABORTED = "aborted"
OK = "ok"


def round_off(col: Column, decimals: int, up: bool) -> Column:
    """Round to ``decimals`` places, away from the inside of a box: up for maxima, down for minima."""
    scale = F.lit(float(10**decimals))
    scaled = col * scale
    return (F.ceil(scaled) if up else F.floor(scaled)) / scale


def in_box(x: Column, y: Column, box, boundary: str = "closed") -> Column:
    """Is (x, y) inside ``box = (min_x, max_x, min_y, max_y)``?

    ``closed`` counts all four edges, ``half_open`` leaves out the two upper ones.
    """
    min_x, max_x, min_y, max_y = (v if isinstance(v, Column) else F.lit(v) for v in box)
    if boundary == "closed":
        return x.between(min_x, max_x) & y.between(min_y, max_y)
    return (x >= min_x) & (x < max_x) & (y >= min_y) & (y < max_y)


def metres_to_degrees(col: Column) -> Column:
    """Planar conversion used for join radii given in metres."""
    return col / F.lit(METRES_PER_DEGREE)


def encode_cut(i: Column, j: Column, direction: Column, nx: int) -> Column:
    """Cut at grid row i, column j; direction 0 is horizontal, 1 is vertical."""
    return ((i * nx + j) * 2 + direction).cast("int")


def decode_cut(action: Column, nx: int) -> tuple[Column, Column, Column]:
    """Row, column and direction of an encoded cut."""
    cell = F.floor(action / 2)
    return (
        F.floor(cell / nx).cast("int"),
        (cell % nx).cast("int"),
        (action % 2).cast("int"),
    )


def priority(td_error: Column) -> Column:
    """Sampling priority of a row from the size of its error."""
    return F.pow(F.abs(td_error) + F.lit(PRIORITY_FLOOR), F.lit(PRIORITY_POWER))


def reward(best: Column, cost: Column, status: Column) -> Column:
    """Squared ratio of the best cost so far to this cost; a fixed value for an aborted run."""
    return F.when(status == F.lit(ABORTED), F.lit(ABORTED_REWARD)).otherwise(
        F.pow(F.try_divide(best, cost), F.lit(2.0))
    )


#: A toss has this many values: 13 hexadecimal digits.
TOSSES = 16**13


def toss(seed: int, *keys: str) -> Column:
    """Whole number from 0 below TOSSES, fixed by a seed and keys; any engine with md5 gives the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def nearest_index(candidates: Column, value: Column) -> Column:
    """Index field of the (idx, value) struct nearest to ``value``; the lowest index wins a tie."""
    return F.array_min(
        F.transform(
            candidates,
            lambda c: F.struct(F.abs(c["value"] - value).alias("gap"), c["idx"].alias("idx")),
        )
    )["idx"]
