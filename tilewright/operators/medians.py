"""Exact medians per group without gathering a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators.assign import assign_partitions
from tilewright.operators.grid import Grid
from tilewright.operators.layout import LAYOUT_KEY
from tilewright.session import pin

# Rows of one group that a task may hold for an exact median.
MEDIAN_ROWS = 1_000_000

# Intervals per refinement pass over a large group.
BINS = 1024


def grouped_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str], limit: int = MEDIAN_ROWS) -> DataFrame:
    """Median of each column per group; an even group averages its two middle values.

    Groups within ``limit`` rows use the built-in median. Larger ones are
    narrowed first: each pass counts values in intervals around the wanted rank
    and keeps the interval that holds it, until at most ``limit`` rows remain.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = pin(sizes.filter(F.col("_n") > limit))
    plain = [F.median(c).alias(c) for c in cols]
    if large.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    small = df.join(large, keys, "left_anti").groupBy(*keys).agg(*plain)
    return small.unionByName(large_medians(df, keys, cols, large, limit))


def large_medians(df: DataFrame, keys: list[str], cols: Sequence[str], large: DataFrame, limit: int) -> DataFrame:
    """Medians of the groups listed in ``large(keys, _n)``.

    The search state has one row per group, column and wanted rank, so at most
    four rows per large group and two columns.
    """
    values = df.join(large.select(*keys), keys).select(
        *keys, F.explode(F.array(*[
            F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols
        ])).alias("_cv"),
    ).select(*keys, "_cv.*")
    group = [*keys, "_col"]
    want = [*group, "_target"]

    ends = values.groupBy(*group).agg(
        F.count("_v").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    targets = F.array_distinct(
        F.array(F.floor((F.col("_rows") - 1) / 2), F.floor(F.col("_rows") / 2))
    )
    state = pin(
        ends.withColumn("_target", F.explode(targets)).withColumn("_rank", F.col("_target"))
    )
    open_rows = (F.col("_rows") > limit) & (F.col("_lo") < F.col("_hi"))
    while not state.filter(open_rows).isEmpty():
        state = pin(
            state.filter(~open_rows).unionByName(narrow(values, state.filter(open_rows), group, want))
        )

    single = state.filter(F.col("_lo") == F.col("_hi")).select(*want, F.col("_lo").alias("_v"))
    rest = state.filter(F.col("_lo") < F.col("_hi"))
    inside = values.join(rest, group).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    ranked = inside.withColumn("_row", F.row_number().over(W.partitionBy(*want).orderBy("_v")) - 1)
    found = ranked.filter(F.col("_row") == F.col("_rank")).select(*want, "_v")
    medians = single.unionByName(found).groupBy(*group).agg(F.avg("_v").alias("_v"))
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_col") == c, F.col("_v"))).alias(c) for c in cols]
    )


def narrow(values: DataFrame, state: DataFrame, group: list[str], want: list[str]) -> DataFrame:
    """One pass: keep, for each wanted rank, the interval of its range that holds it."""
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    inside = values.join(state.drop("_rows"), group).filter(v.between(lo, hi))
    place = F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
    bins = inside.groupBy(*want, "_rank", place.alias("_bin")).agg(
        F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    upto = F.sum("_rows").over(W.partitionBy(*want).orderBy("_bin"))
    before = F.col("_upto") - F.col("_rows")
    return (
        bins.withColumn("_upto", upto)
        .filter((before <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
        .withColumn("_rank", F.col("_rank") - before)
        .select(*group, "_rows", "_lo", "_hi", "_target", "_rank")
    )


def partition_medians(
    points: DataFrame, layout: DataFrame, grid: Grid, boundary: str = "half_open", limit: int = MEDIAN_ROWS
) -> DataFrame:
    """medians(layout_id, pid, median_x, median_y); 0, 0 for an empty partition."""
    keys = [LAYOUT_KEY, "pid"]
    placed = assign_partitions(points.select("x", "y"), layout, grid, boundary, outside="drop")
    medians = grouped_median(placed, keys, ["x", "y"], limit)
    return layout.select(*keys).join(medians, keys, "left").select(
        *keys,
        F.coalesce("x", F.lit(0.0)).alias("median_x"),
        F.coalesce("y", F.lit(0.0)).alias("median_y"),
    )
