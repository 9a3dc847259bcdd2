"""Estimated cost of layouts without running a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.assign import block_counts, circle_stats, owner_counts
from tilewright.operators.grid import Grid
from tilewright.operators.layout import LAYOUT_KEY


def partition_loads(
    points: DataFrame, layouts: DataFrame, workload: DataFrame, grid: Grid, boundary: str = "half_open"
) -> DataFrame:
    """loads(layout_id, qid, pid, n, m, load): points, circle copies and their product.

    Exact, and two passes over the points whatever the number of layouts.
    """
    keys = [LAYOUT_KEY, "pid"]
    points_in = owner_counts(block_counts(points, grid, boundary=boundary), layouts, grid, "n")
    copies = circle_stats(points, layouts, workload, grid, boundary)
    qids = workload.agg(F.array_sort(F.collect_set("qid"))).scalar()
    rows = layouts.select(*keys, F.explode(qids).alias("qid"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    m = F.coalesce("m", F.lit(0)).cast("bigint")
    return (
        rows.join(points_in.drop("qid"), keys, "left")
        .join(copies, [*keys, "qid"], "left")
        .select(LAYOUT_KEY, "qid", "pid", n.alias("n"), m.alias("m"), (n * m).alias("load"))
    )


def over_partitions(how: str, load: Column) -> Column:
    return F.max(load) if how == "max" else F.sum(load)


def estimate_cost(
    points: DataFrame, layouts: DataFrame, workload: DataFrame, grid: Grid, how: str = "max",
    boundary: str = "half_open",
) -> DataFrame:
    """(layout_id, cost): over the queries, rate times the largest (or summed) partition load."""
    loads = partition_loads(points, layouts, workload, grid, boundary)
    per_query = loads.groupBy(LAYOUT_KEY, "qid").agg(over_partitions(how, F.col("load")).alias("load"))
    return (
        per_query.join(workload.select("qid", "rate"), "qid")
        .groupBy(LAYOUT_KEY)
        .agg(F.sum(F.col("load") * F.col("rate")).alias("cost"))
    )
