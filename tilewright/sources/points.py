"""Point tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, order: str = "xy", id_col: str | None = None) -> DataFrame:
    """points(id, x, y) from headerless CSV files.

    ``order`` names the first two columns: "xy" (longitude first) or "yx". With
    ``id_col`` the third column is the id. Otherwise rows are numbered by file
    split and position, which stays the same when a lost task is run again.
    """
    names = {"xy": ["x", "y"], "yx": ["y", "x"]}[order]
    fields = [f"{n} double" for n in names] + ([f"{id_col} bigint"] if id_col else [])
    rows = spark.read.schema(", ".join(fields)).csv(path)
    number = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return rows.select(number.alias("id"), "x", "y")


def spread_points(points: DataFrame, partitions: int = 8) -> DataFrame:
    """Points in a fixed number of partitions, kept in memory."""
    return points.repartition(partitions).persist(StorageLevel.MEMORY_ONLY)
