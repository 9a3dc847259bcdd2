"""Layouts as one array per row.

A layout is ``parts array<struct<c0,c1,r0,r1>>``: the rectangle of partition p
covers grid columns [c0, c1) and rows [r0, r1), and p is its position in the
array. Cutting is then a projection, so any number of candidate layouts can be
cut at once without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.scalar import decode_cut

RECT_DDL = "struct<c0:int,c1:int,r0:int,r1:int>"


def rect(c0, c1, r0, r1) -> Column:
    fields = {"c0": c0, "c1": c1, "r0": r0, "r1": r1}
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(k) for k, v in fields.items()]
    )


def covers(part: Column, i: Column, j: Column) -> Column:
    """Does the rectangle own grid cell (i, j)?"""
    return (i >= part["r0"]) & (i < part["r1"]) & (j >= part["c0"]) & (j < part["c1"])


def lower_part(part: Column, i: Column, j: Column, direction: Column) -> Column:
    """The lower or left piece, which keeps the partition id."""
    return rect(
        part["c0"],
        F.when(direction == 1, j).otherwise(part["c1"]),
        part["r0"],
        F.when(direction == 0, i).otherwise(part["r1"]),
    )


def upper_part(part: Column, i: Column, j: Column, direction: Column) -> Column:
    """The upper or right piece, which gets the next free id."""
    return rect(
        F.when(direction == 1, j).otherwise(part["c0"]),
        part["c1"],
        F.when(direction == 0, i).otherwise(part["r0"]),
        part["r1"],
    )


def splits_inside(part: Column, i: Column, j: Column, direction: Column) -> Column:
    """Does the cut line run strictly inside the rectangle?"""
    return F.when(direction == 0, (i > part["r0"]) & (i < part["r1"])).otherwise(
        (j > part["c0"]) & (j < part["c1"])
    )


def cut_parts(parts: Column, action: Column, nx: int) -> Column:
    """Apply one cut to a layout array; the query fails on a cut that splits nothing."""
    i, j, d = decode_cut(action, nx)
    owners = F.filter(parts, lambda p: covers(p, i, j) & splits_inside(p, i, j, d))
    kept = F.transform(
        parts, lambda p: F.when(covers(p, i, j), lower_part(p, i, j, d)).otherwise(p)
    )
    added = F.transform(owners, lambda p: upper_part(p, i, j, d))
    return F.when(F.size(owners) == 1, F.concat(kept, added)).otherwise(
        F.raise_error(F.concat(F.lit("cut splits no partition: "), action.cast("string")))
    )


def inner_lines(start: Column, stop: Column) -> Column:
    """Grid line indices strictly between two lines; empty for a rectangle one cell wide."""
    return F.when(stop - start >= 2, F.sequence(start + 1, stop - 1)).otherwise(
        F.array().cast("array<int>")
    )


def legal_cut_list(part: Column) -> Column:
    """All cuts of one rectangle as array<struct<dir,i,j>>.

    A horizontal cut is anchored at the left edge, a vertical one at the bottom edge.
    """

    def cut(direction, i, j):
        return F.struct(
            F.lit(direction).alias("dir"), i.cast("int").alias("i"), j.cast("int").alias("j")
        )

    return F.concat(
        F.transform(inner_lines(part["r0"], part["r1"]), lambda i: cut(0, i, part["c0"])),
        F.transform(inner_lines(part["c0"], part["c1"]), lambda j: cut(1, part["r0"], j)),
    )
