"""Layout algebra: root, cuts, replay, owners, raster, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import rectangles as R
from tilewright.functions.scalar import encode_cut
from tilewright.operators.grid import Grid, line_value
from tilewright.session import local_table

LAYOUT_KEY = "layout_id"
RECT_COLUMNS = ["c0", "c1", "r0", "r1"]


def with_coordinates(layout: DataFrame, grid: Grid) -> DataFrame:
    """Add min_x, max_x, min_y, max_y from the grid indices."""
    return layout.withColumns(
        {
            "min_x": line_value(F.col("c0"), grid, "x"),
            "max_x": line_value(F.col("c1"), grid, "x"),
            "min_y": line_value(F.col("r0"), grid, "y"),
            "max_y": line_value(F.col("r1"), grid, "y"),
        }
    )


def layout_from_rects(spark: SparkSession, rects: Sequence[Sequence[int]], grid: Grid, layout_id: int = 0) -> DataFrame:
    """Layout table from index rectangles (c0, c1, r0, r1) in pid order."""
    rows = [(layout_id, pid, *map(int, r)) for pid, r in enumerate(rects)]
    table = local_table(spark, rows, "layout_id int, pid int, c0 int, c1 int, r0 int, r1 int")
    return with_coordinates(table, grid)


def root_layout(spark: SparkSession, grid: Grid, layout_id: int = 0) -> DataFrame:
    """One partition over the whole box; it holds every point."""
    root = layout_from_rects(spark, [(0, grid.nx, 0, grid.ny)], grid, layout_id)
    return root.withColumn("share", F.lit(1.0))


def nest(layout: DataFrame) -> DataFrame:
    """One row per layout with its rectangles as an array in pid order.

    The array length is the number of partitions of the layout, never a number of points.
    """
    part = F.struct("pid", *RECT_COLUMNS)
    sorted_parts = F.array_sort(F.collect_list(part))
    return layout.groupBy(LAYOUT_KEY).agg(
        F.transform(
            sorted_parts, lambda p: R.rect(p["c0"], p["c1"], p["r0"], p["r1"])
        ).alias("parts")
    )


def flatten(nested: DataFrame, grid: Grid) -> DataFrame:
    """Back to one row per partition, with coordinates."""
    rows = nested.select(LAYOUT_KEY, F.posexplode("parts").alias("pid", "part"))
    return with_coordinates(rows.select(LAYOUT_KEY, "pid", "part.*"), grid)


def legal_cuts(layout: DataFrame, grid: Grid) -> DataFrame:
    """cuts(layout_id, pid, dir, i, j, action): every cut that may be applied next."""
    part = R.rect(*[F.col(c) for c in RECT_COLUMNS])
    cuts = layout.select(LAYOUT_KEY, "pid", F.explode(R.legal_cut_list(part)).alias("cut"))
    action = encode_cut(F.col("cut.i"), F.col("cut.j"), F.col("cut.dir"), grid.nx)
    return cuts.select(LAYOUT_KEY, "pid", "cut.dir", "cut.i", "cut.j", action.alias("action"))


def apply_cut(layout: DataFrame, action: int | Column, grid: Grid) -> DataFrame:
    """Apply the same cut to every layout in the table."""
    cut = action if isinstance(action, Column) else F.lit(action)
    nested = nest(layout)
    return flatten(nested.withColumn("parts", R.cut_parts(F.col("parts"), cut, grid.nx)), grid)


def apply_cuts(layouts: DataFrame, cuts: DataFrame, grid: Grid) -> DataFrame:
    """Apply to each layout its own cut from ``cuts(layout_id, action)``.

    Layouts without a cut are left as they are.
    """
    chosen = cuts.select(LAYOUT_KEY, F.col("action"))
    nested = nest(layouts).join(chosen, LAYOUT_KEY, "left")
    parts = F.when(F.col("action").isNull(), F.col("parts")).otherwise(
        R.cut_parts(F.col("parts"), F.col("action"), grid.nx)
    )
    return flatten(nested.withColumn("parts", parts), grid)


def replay_cuts(spark: SparkSession, grid: Grid, actions: Sequence[int], layout_id: int = 0) -> DataFrame:
    """Layout reached from the root by a cut sequence."""
    root = F.array(R.rect(0, grid.nx, 0, grid.ny)).cast(f"array<{R.RECT_DDL}>")
    nested = local_table(spark, [(layout_id, list(actions))], "layout_id int, actions array<int>")
    parts = F.aggregate("actions", root, lambda parts, a: R.cut_parts(parts, a, grid.nx).cast(f"array<{R.RECT_DDL}>"))
    return flatten(nested.select(LAYOUT_KEY, parts.alias("parts")), grid)


def cell_owner(layout: DataFrame) -> DataFrame:
    """owner(layout_id, i, j, pid): each cell of each layout once.

    The rectangles list their own cells, so this is a projection and not a range join.
    """
    return (
        layout.select(
            LAYOUT_KEY, "pid", "c0", "c1",
            F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)).alias("i"),
        )
        .select(
            LAYOUT_KEY, "pid", "i",
            F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("j"),
        )
        .select(LAYOUT_KEY, "i", "j", "pid")
    )


def layout_raster(cells: DataFrame, layout: DataFrame, grid: Grid) -> DataFrame:
    """raster(layout_id, i, j, h_line, v_line, weight) on the (ny+1) x (nx+1) lattice.

    ``cells`` needs ``weight``, ``layout`` needs ``share``. A lattice point
    carries a horizontal (vertical) flag when the line segment that starts there
    and runs right (up) belongs to a rectangle edge or to the outer frame.
    Weight is the cell weight times the share of the owning partition.
    """
    ny, nx = grid.ny, grid.nx
    ids = layout.select(LAYOUT_KEY).distinct()
    lattice = ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ny)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(nx)))
    )
    owned = cell_owner(layout).join(
        layout.select(LAYOUT_KEY, "pid", "r0", "c0", "share"), [LAYOUT_KEY, "pid"]
    )
    filled = owned.join(cells.select("i", "j", F.col("weight").alias("cell_weight")), ["i", "j"])
    h_line = F.when((F.col("i") == ny) & (F.col("j") < nx), 1).when(F.col("i") == F.col("r0"), 1)
    v_line = F.when((F.col("j") == nx) & (F.col("i") < ny), 1).when(F.col("j") == F.col("c0"), 1)
    return lattice.join(filled, [LAYOUT_KEY, "i", "j"], "left").select(
        LAYOUT_KEY, "i", "j",
        h_line.otherwise(0).cast("tinyint").alias("h_line"),
        v_line.otherwise(0).cast("tinyint").alias("v_line"),
        F.coalesce(F.col("cell_weight") * F.col("share"), F.lit(0.0)).alias("weight"),
    )


def layout_difference(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of either layout that the other does not have, with the side they come from."""
    columns = list(columns or ["pid", *RECT_COLUMNS])
    left, right = a.select(*columns), b.select(*columns)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def same_layout(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> bool:
    """Do two layouts (or two cut sequences, given their columns) agree row by row?"""
    return layout_difference(a, b, columns).isEmpty()
