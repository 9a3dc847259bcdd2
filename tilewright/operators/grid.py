"""Bounding box, grid lines, cells and per-cell density."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.scalar import in_box, nearest_index, round_off


@dataclass(frozen=True)
class Grid:
    """A regular grid: four bounds and two counts, small enough to live in plan literals."""

    min_x: float
    max_x: float
    min_y: float
    max_y: float
    nx: int
    ny: int

    @property
    def cells(self) -> int:
        return self.nx * self.ny

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.min_x, self.max_x, self.min_y, self.max_y

    def axis(self, name: str) -> tuple[float, float, int, float]:
        """Lower bound, upper bound, number of cells and step of one axis."""
        low, high, n = (
            (self.min_x, self.max_x, self.nx) if name == "x" else (self.min_y, self.max_y, self.ny)
        )
        return low, high, n, (high - low) / n

    def line(self, name: str, idx: int) -> float:
        low, high, n, step = self.axis(name)
        return high if idx == n else idx * step + low


def bounding_box(points: DataFrame, decimals: int = 5, compat: bool = False) -> DataFrame:
    """One row of outward-rounded bounds. ``compat`` rounds max_y down instead."""
    ends = points.agg(
        F.min("x").alias("lo_x"), F.max("x").alias("hi_x"),
        F.min("y").alias("lo_y"), F.max("y").alias("hi_y"),
    )
    return ends.select(
        round_off(F.col("lo_x"), decimals, up=False).alias("min_x"),
        round_off(F.col("hi_x"), decimals, up=True).alias("max_x"),
        round_off(F.col("lo_y"), decimals, up=False).alias("min_y"),
        round_off(F.col("hi_y"), decimals, up=not compat).alias("max_y"),
    )


def make_grid(bbox: DataFrame | tuple, ny: int = 30, nx: int = 30) -> Grid:
    """Grid over a bounding box, given as its one-row table or as four numbers."""
    bounds = bbox.first() if isinstance(bbox, DataFrame) else bbox
    return Grid(*[float(v) for v in bounds], nx=nx, ny=ny)


def grid_lines(spark: SparkSession, grid: Grid) -> DataFrame:
    """Table of the nx+1 and ny+1 equally spaced lines: (axis, idx, value)."""
    axes = [
        spark.range(n + 1).select(
            F.lit(axis).alias("axis"),
            F.col("id").cast("int").alias("idx"),
            line_value(F.col("id"), grid, axis).alias("value"),
        )
        for axis, n in (("x", grid.nx), ("y", grid.ny))
    ]
    return axes[0].unionByName(axes[1])


def number(v: float) -> str:
    """SQL text of a double."""
    return f"{float(v)!r}D"


def line_value(idx: Column, grid: Grid, axis: str) -> Column:
    """Coordinate of a grid line; the last line is the upper bound itself."""
    low, high, n, step = grid.axis(axis)
    return F.when(idx == n, F.lit(high)).otherwise(idx * F.lit(step) + F.lit(low))


def line_index(value: Column, grid: Grid, axis: str) -> Column:
    """Index of the grid line a coordinate stands for."""
    low, _, n, step = grid.axis(axis)
    snapped = F.coalesce(F.round(F.try_divide(value - low, F.lit(step))), F.lit(0.0))
    return F.least(F.greatest(snapped, F.lit(0.0)), F.lit(float(n))).cast("int")


def cell_text(value: str, grid: Grid, axis: str) -> str:
    """SQL text for the grid column or row of a coordinate, clamped to the grid, cells closed below.
    Null for a null coordinate.

    The division can land on the wrong side of a line by a rounding error, so
    the result is corrected against the line values themselves.
    """
    low, _, n, step = grid.axis(axis)
    if step == 0:
        return f"CASE WHEN ({value}) IS NOT NULL THEN 0 END"
    low, step = number(low), number(step)
    raw = f"floor((({value}) - {low}) / {step})"
    below = f"CASE WHEN ({value}) < {raw} * {step} + {low} THEN 1 ELSE 0 END"
    above = f"CASE WHEN ({value}) >= ({raw} + 1) * {step} + {low} THEN 1 ELSE 0 END"
    return f"CASE WHEN ({value}) IS NOT NULL THEN CAST(least(greatest({raw} - {below} + {above}, 0), {n - 1}) AS INT) END"


def cell_index(value: str, grid: Grid, axis: str) -> Column:
    """Grid column or row of a coordinate, given as a column name or SQL expression."""
    return F.expr(cell_text(value, grid, axis))


def cell_span(low: str, high: str, grid: Grid, axis: str, boundary: str) -> tuple[Column, Column]:
    """First and last cell index met by the interval [low, high].

    With ``closed`` cells an interval that starts exactly on a line also meets
    the cell below that line.
    """
    first = cell_text(low, grid, axis)
    start, _, _, step = grid.axis(axis)
    if boundary == "closed":
        on_line = f"({low}) = ({first}) * {number(step)} + {number(start)}"
        first = f"CASE WHEN ({low}) IS NOT NULL THEN greatest(({first}) - CASE WHEN {on_line} THEN 1 ELSE 0 END, 0) END"
    return F.expr(first), cell_index(high, grid, axis)


def inside_grid(grid: Grid) -> Column:
    return in_box(F.col("x"), F.col("y"), grid.box)


def assign_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Add the grid row ``i`` and column ``j`` of each point; points outside go to the edge cells."""
    return points.withColumns(
        {"i": cell_index("y", grid, "y"), "j": cell_index("x", grid, "x")}
    )


def cell_counts(points: DataFrame, grid: Grid, boundary: str = "half_open") -> DataFrame:
    """Points per non-empty cell. Counted before the shuffle, so at most one row per cell and task moves."""
    inside = points.filter(inside_grid(grid))
    if boundary == "closed":
        i0, i1 = cell_span("y", "y", grid, "y", boundary)
        j0, j1 = cell_span("x", "x", grid, "x", boundary)
        spans = inside.groupBy(
            i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1")
        ).agg(F.count("*").alias("n"))
        return (
            spans.withColumn("i", F.explode(F.sequence("i0", "i1")))
            .withColumn("j", F.explode(F.sequence("j0", "j1")))
            .groupBy("i", "j")
            .agg(F.sum("n").alias("n"))
        )
    return assign_cells(inside, grid).groupBy("i", "j").agg(F.count("*").alias("n"))


def all_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every (i, j) of the grid."""
    return spark.range(grid.cells).select(
        F.floor(F.col("id") / grid.nx).cast("int").alias("i"),
        (F.col("id") % grid.nx).cast("int").alias("j"),
    )


def grid_histogram(points: DataFrame, grid: Grid, boundary: str = "half_open") -> DataFrame:
    """cells(i, j, n, density): one row per cell, empty ones included; density = n / all points."""
    total = points.agg(F.count("*").cast("double")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return (
        all_cells(points.sparkSession, grid)
        .join(cell_counts(points, grid, boundary), ["i", "j"], "left")
        .select("i", "j", n.alias("n"), (n / total).alias("density"))
    )


def cell_weight(cells: DataFrame) -> DataFrame:
    """Add ``weight``: density scaled by the densest cell."""
    top = cells.agg(F.max("density")).scalar()
    return cells.withColumn("weight", F.coalesce(F.try_divide(F.col("density"), top), F.lit(0.0)))


def minmax_scale(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0, out: str = "scaled") -> DataFrame:
    """Scale a column linearly to [lo, hi]; null when all its values are equal."""
    ends = df.agg(F.struct(F.min(col).alias("a"), F.max(col).alias("b"))).scalar()
    share = F.try_divide(F.col(col) - ends["a"], ends["b"] - ends["a"])
    return df.withColumn(out, share * F.lit(hi - lo) + F.lit(lo))


def nearest_line(df: DataFrame, grid: Grid, axis: str, value: Column, first: Column, last: Column) -> DataFrame:
    """Add ``line``: the grid line between indices first and last nearest to ``value``, lowest on a tie."""
    lines = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    candidates = F.transform(
        lines,
        lambda k: F.struct(k.alias("idx"), line_value(k, grid, axis).alias("value")),
    )
    return df.withColumn("line", nearest_index(candidates, value))
