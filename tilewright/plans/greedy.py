"""Median cuts and the greedy layout, planned from one pass over the points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.grid import Grid, cell_index, inside_grid, line_value, number
from tilewright.operators.layout import LAYOUT_KEY, RECT_COLUMNS, layout_from_rects
from tilewright.session import local_table, pin

Rect = tuple[int, int, int, int]

# Positions per grid step: on the line, nearer to this line, nearer to the next line.
STEP = 4
NEXT_HALF = 2


@dataclass(frozen=True)
class Split:
    """What is known about one rectangle: its size and its median cut, if it has one."""

    n: int
    axis: str
    line: int | None
    n_low: int
    n_high: int


def position(axis: str, grid: Grid) -> Column:
    """Where a coordinate in grid cell ``_k`` lies between grid lines, as one ordered integer.

    Line k is STEP * k. Above it, up to the next line, values nearer to line k
    get STEP * k + 1 and values nearer to line k + 1 get STEP * k + 2. All
    values of one position have the same nearest line, and rectangles start
    and stop at positions, whether their edges count as inside or not.
    """
    v, k = F.col(axis), F.col("_k")
    low, high = line_value(k, grid, axis), line_value(k + 1, grid, axis)
    half = F.when(F.abs(low - v) <= F.abs(high - v), 1).otherwise(NEXT_HALF)
    return k * STEP + F.when(v == low, 0).when(v == high, STEP).otherwise(half)


def profile_points(points: DataFrame, grid: Grid) -> DataFrame:
    """profile(px, py, n, lo_x, hi_x, lo_y, hi_y): points summed up by position on both axes.

    Its size depends on the grid only. It is exact for everything a median cut
    needs: counts, the position of any rank, and the end values of a position.
    """
    inside = points.filter(inside_grid(grid))
    for axis in ("x", "y"):
        inside = inside.withColumn("_k", cell_index(axis, grid, axis)).withColumn(
            f"p{axis}", position(axis, grid)
        )
    profile = inside.groupBy("px", "py").agg(
        F.count("*").alias("n"),
        F.min("x").alias("lo_x"), F.max("x").alias("hi_x"),
        F.min("y").alias("lo_y"), F.max("y").alias("hi_y"),
    )
    return pin(profile)


# Cuts of many rectangles at once. ``boxes`` lists each rectangle with its range
# of positions on both axes. The rectangle lists its own positions, so that it
# meets the profile by equality.
SPLITS = """
WITH listed AS (
  SELECT leaf, tall, first, last, px, explode(sequence(y_from, y_to)) AS py
  FROM (SELECT *, explode(sequence(x_from, x_to)) AS px FROM {boxes})
), lines AS (
  SELECT leaf, tall, first, last, IF(tall, py, px) AS pos, sum(n) AS n,
         min(IF(tall, lo_y, lo_x)) AS lo, max(IF(tall, hi_y, hi_x)) AS hi
  FROM listed JOIN {profile} USING (px, py)
  GROUP BY leaf, tall, first, last, IF(tall, py, px)
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY leaf ORDER BY pos) AS upto,
         sum(n) OVER (PARTITION BY leaf) AS total
  FROM lines
), middle AS (
  SELECT *,
    max(IF((total - 1) div 2 BETWEEN upto - n AND upto - 1, pos, NULL)) OVER w AS pos_low,
    max(IF(total div 2 BETWEEN upto - n AND upto - 1, pos, NULL)) OVER w AS pos_high,
    max(IF((total - 1) div 2 BETWEEN upto - n AND upto - 1, hi, NULL)) OVER w AS end_low,
    max(IF(total div 2 BETWEEN upto - n AND upto - 1, lo, NULL)) OVER w AS start_high
  FROM ranked WINDOW w AS (PARTITION BY leaf)
), aimed AS (
  SELECT *, (end_low + start_high) / 2 AS mean, """ f"""
    (pos_low + {STEP - NEXT_HALF}) div {STEP} AS home_low,
    (pos_high + {STEP - NEXT_HALF}) div {STEP} AS home_high""" """
  FROM middle
), cut AS (
  SELECT *, CASE WHEN last - first >= 2 THEN
      least(greatest(IF(pos_low = pos_high, home_low, {nearest}), first + 1), last - 1)
    END AS line
  FROM aimed
)
SELECT leaf, max(total) AS n, CAST(max(line) AS INT) AS line,
       sum(IF({below}, n, 0)) AS n_low, sum(IF(pos >= {step} * line, n, 0)) AS n_high
FROM cut GROUP BY leaf
"""


def nearest_text(grid: Grid) -> str:
    """SQL text for the line nearest to ``mean``, the lowest on a tie.

    Used when the two middle values lie in different positions: the lower one is
    then the largest value of its position, the upper one the smallest of its own.
    """

    def among(axis: str) -> str:
        low, high, n, step = grid.axis(axis)
        value = f"IF(k = {n}, {number(high)}, k * {number(step)} + {number(low)})"
        around = f"sequence(greatest(home_low - 1, 0), least(home_high + 1, {n}))"
        return f"array_min(transform({around}, k -> struct(abs({value} - mean) AS gap, k AS k))).k"

    return f"IF(tall, {among('y')}, {among('x')})"


def median_splits(
    spark: SparkSession, profile: DataFrame, rects: Sequence[Rect], grid: Grid, boundary: str
) -> dict[Rect, Split]:
    """Size and median cut of every given rectangle, in one job over the profile.

    A rectangle strictly taller than wide is cut at the grid row line nearest to
    its median y, any other at the column line nearest to its median x. The
    lowest line wins a tie, and a rectangle without an inner line has no cut.
    """
    closed = boundary == "closed"

    def position_range(low: int, high: int, n: int) -> tuple[int, int]:
        return STEP * low, STEP * high - (0 if closed or high == n else 1)

    def is_tall(rect: Rect) -> bool:
        c0, c1, r0, r1 = rect
        height = grid.line("y", r1) - grid.line("y", r0)
        return height > grid.line("x", c1) - grid.line("x", c0)

    rows = []
    for leaf, (c0, c1, r0, r1) in enumerate(rects):
        tall = is_tall((c0, c1, r0, r1))
        ends = (r0, r1) if tall else (c0, c1)
        rows.append(
            (leaf, tall, *ends, *position_range(c0, c1, grid.nx), *position_range(r0, r1, grid.ny))
        )
    boxes = local_table(
        spark, rows,
        "leaf int, tall boolean, first int, last int, x_from int, x_to int, y_from int, y_to int",
    )
    query = SPLITS.replace("{nearest}", nearest_text(grid)).replace("{step}", str(STEP))
    query = query.replace("{below}", f"pos {'<=' if closed else '<'} {STEP} * line")
    found = {r.leaf: r for r in spark.sql(query, boxes=boxes, profile=profile).collect()}
    splits = {}
    for leaf, rect in enumerate(rects):
        axis = "y" if is_tall(rect) else "x"
        row = found.get(leaf)
        splits[rect] = Split(row.n, axis, row.line, row.n_low, row.n_high) if row else Split(0, axis, None, 0, 0)
    return splits


def action_of(rect: Rect, split: Split, grid: Grid) -> int:
    """The encoded cut of a rectangle at its split line."""
    c0, _, r0, _ = rect
    i, j, d = (split.line, c0, 0) if split.axis == "y" else (r0, split.line, 1)
    return 2 * (i * grid.nx + j) + d


def halves(rect: Rect, split: Split) -> tuple[Rect, Rect]:
    c0, c1, r0, r1 = rect
    if split.axis == "y":
        return (c0, c1, r0, split.line), (c0, c1, split.line, r1)
    return (c0, split.line, r0, r1), (split.line, c1, r0, r1)


def median_cut(points: DataFrame, layout: DataFrame, grid: Grid, boundary: str = "half_open") -> DataFrame:
    """cuts(layout_id, pid, dir, i, j, action): the median cut of the fullest partition of each layout.

    No row for a layout whose fullest partition has no inner line on the side to be cut. The
    lowest pid wins a tie. One job splits the rectangles of all layouts.
    """
    spark = points.sparkSession
    by_layout: dict[int, list] = {}
    for r in layout.select(LAYOUT_KEY, "pid", *RECT_COLUMNS).orderBy(LAYOUT_KEY, "pid").collect():
        by_layout.setdefault(r[LAYOUT_KEY], []).append((r.pid, (r.c0, r.c1, r.r0, r.r1)))
    rects = list(dict.fromkeys(rect for rows in by_layout.values() for _, rect in rows))
    splits = median_splits(spark, profile_points(points, grid), rects, grid, boundary)
    out = []
    for key, rows in by_layout.items():
        pid, rect = max(rows, key=lambda row: (splits[row[1]].n, -row[0]))
        split = splits[rect]
        if split.line is not None:
            d, i, j = (0, split.line, rect[0]) if split.axis == "y" else (1, rect[2], split.line)
            out.append((key, pid, d, i, j, action_of(rect, split, grid)))
    return local_table(spark, out, "layout_id int, pid int, dir int, i int, j int, action int")


def greedy_steps(
    points: DataFrame, grid: Grid, max_partitions: int = 8, boundary: str = "half_open"
) -> tuple[list[Rect], list[int], list[int]]:
    """Rectangles, point counts and the cut sequence of the greedy layout.

    The cut of a rectangle does not depend on the others, so each job finds the
    cuts of all rectangles that could still be chosen. Those hold at least
    1/max_partitions of the points, because the fullest one always does. The
    number of jobs is the depth of the cut tree, not the number of cuts.
    """
    spark = points.sparkSession
    profile = profile_points(points, grid)
    root = (0, grid.nx, 0, grid.ny)
    known = median_splits(spark, profile, [root], grid, boundary)
    total = known[root].n
    rects, counts, actions = [root], [total], []
    while len(rects) < max_partitions:
        k = max(range(len(rects)), key=lambda p: (counts[p], -p))
        if rects[k] not in known:
            ready = [
                r for r, n in zip(rects, counts) if r not in known and n * max_partitions >= total
            ]
            known |= median_splits(spark, profile, ready or [rects[k]], grid, boundary)
        split = known[rects[k]]
        if split.line is None:
            break
        actions.append(action_of(rects[k], split, grid))
        low, high = halves(rects[k], split)
        rects[k], counts[k] = low, split.n_low
        rects.append(high)
        counts.append(split.n_high)
    return rects, counts, actions


def greedy_layout(
    points: DataFrame, grid: Grid, max_partitions: int = 8, boundary: str = "half_open", layout_id: int = 0
) -> DataFrame:
    """Cut the fullest partition at its median until ``max_partitions`` exist.

    Stops early when the fullest partition cannot be cut.
    """
    spark = points.sparkSession
    rects, counts, _ = greedy_steps(points, grid, max_partitions, boundary)
    layout = layout_from_rects(spark, rects, grid, layout_id)
    total = points.count()
    sizes = [(p, n, n / total if total else 0.0) for p, n in enumerate(counts)]
    return layout.join(local_table(spark, sizes, "pid int, n bigint, share double"), "pid").select(
        *layout.columns, "n", "share"
    )
