"""Layout files: min_x,max_x,min_y,max_y per line, the line number is the pid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.grid import Grid, line_index
from tilewright.operators.layout import LAYOUT_KEY, with_coordinates
from tilewright.sources.vectors import numbered, whole_files


def write_layout(layout: DataFrame, path: str) -> None:
    """Write one layout in pid order."""
    box = ["min_x", "max_x", "min_y", "max_y"]
    one = layout.select("pid", *box).repartition(1).sortWithinPartitions("pid")
    one.select(*box).write.mode("overwrite").csv(path)


def read_layout(spark: SparkSession, path: str, grid: Grid, layout_id: int = 0) -> DataFrame:
    """Read a layout and snap its edges to grid lines. Accepts both line endings.

    The files of a folder are one layout, in the order of their names.
    """
    lines = whole_files(spark, path).select(
        "file", F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("_line", "line")
    )
    edge = F.transform(F.split(F.trim("line"), ","), lambda v: F.trim(v).cast("double"))
    edges = numbered(lines.filter(F.trim("line") != ""), "_line", "pid").withColumn("edge", edge)
    rects = edges.select(
        F.lit(layout_id).alias(LAYOUT_KEY),
        "pid",
        *[
            line_index(F.col("edge")[k], grid, axis).alias(name)
            for k, (name, axis) in enumerate([("c0", "x"), ("c1", "x"), ("r0", "y"), ("r1", "y")])
        ],
    )
    return with_coordinates(rects, grid)
