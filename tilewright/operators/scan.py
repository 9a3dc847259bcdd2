"""Running aggregates over an order, by one plan for tables and groups of any size.

The order is cut into slices at its quantiles over the whole table. The window runs per group
and slice, so no task needs more than a slice, and what the earlier slices of a group add up
to comes from a table with one row per group and slice. The quantiles are a subquery of the
plan: nothing runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.session import shuffle_slots

SLICE = "_slice"

#: Slices at least and at most; in between as many as the session has shuffle partitions.
FEWEST_SLICES, MOST_SLICES = 64, 4096

#: How much finer the quantiles are than the slices.
FINENESS = 16

# How a running value over the rows of a slice joins what came before it.
AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
FOLDS = AGGREGATES | {"count": F.sum}


def merge(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        both = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        return F.when(before.isNotNull() | here.isNotNull(), both)
    return F.least(before, here) if kind == "min" else F.greatest(before, here)


def ordinal(order: str, df: DataFrame) -> Column:
    """The order column as a double, for cutting its range into slices."""
    kind = df.schema[order].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, F.col(order).cast("timestamp_ntz")).cast("double")
    return F.col(order).cast("double")


def slice_count(df: DataFrame, slices: int | None = None) -> int:
    """Number of slices: a power of two."""
    wanted = slices or min(max(shuffle_slots(df.sparkSession), FEWEST_SLICES), MOST_SLICES)
    return 1 << (wanted - 1).bit_length()


def above(bounds: Column, n: int, value: Column) -> Column:
    """How many of ``n - 1`` rising bounds are below the value, by bisection; ``n`` is a power of two."""
    steps = F.array(*[F.lit(n >> k) for k in range(1, n.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda k, step: k + F.when(F.get(bounds, k + step - 1) < value, step).otherwise(0))


def with_slices(df: DataFrame, at: Column, slices: int | None = None) -> DataFrame:
    """Add the slice of each row: slices hold about as many rows each, however ``at`` is spaced, and follow its order.

    Rows with equal ``at`` share a slice; a null lies in the first.
    """
    n = slice_count(df, slices)
    if n == 1:
        return df.withColumn(SLICE, F.lit(0))
    bounds = df.agg(F.percentile_approx(at, [k / n for k in range(1, n)], FINENESS * n)).scalar()
    return df.withColumn("_bounds", bounds).withColumn(SLICE, above(F.col("_bounds"), n, at)).drop("_bounds")


def running(
    df: DataFrame, by: Sequence[str], order: str, values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True, slices: int | None = None, at: Column | None = None,
) -> DataFrame:
    """Add running aggregates ``{name: (kind, value)}`` over ``order`` within each group.

    Kinds: sum, count, min, max, and last (the latest non-null value). Values
    cover the rows up to and including the current one, or only the rows before
    it. ``order`` must be unique within a group; a null order comes first.
    ``at`` is a number that follows the order, for an order column that is none.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    inputs = {}
    for name, (kind, value) in values.items():
        if kind == "last":
            kind = "max"
            value = F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))
        inputs[name] = (kind, value)
    rows = with_slices(base.withColumns({f"_in_{n}": v for n, (_, v) in inputs.items()}), ordinal(order, base) if at is None else at, slices)

    group = [*keys, SLICE]
    sums = rows.groupBy(*group).agg(*[AGGREGATES[k](f"_in_{n}").alias(f"_sum_{n}") for n, (k, _) in inputs.items()])
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*group, *[FOLDS[k](f"_sum_{n}").over(earlier).alias(f"_pre_{n}") for n, (k, _) in inputs.items()])
    frame = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    here = rows.select("*", *[AGGREGATES[k](f"_in_{n}").over(frame).alias(f"_run_{n}") for n, (k, _) in inputs.items()])

    def total(name: str, kind: str) -> Column:
        value = merge(kind, F.col(f"_pre_{name}"), F.col(f"_run_{name}"))
        value = value["v"] if values[name][0] == "last" else value
        return F.coalesce(value, F.lit(0)) if kind == "count" else value

    # Every row has its group's carry; groups with a null key find theirs as well.
    met = here.join(carry.withColumnsRenamed({k: f"_of_{k}" for k in group}), null_safe(group), "left")
    return met.select(*df.columns, *[total(n, k).alias(n) for n, (k, _) in inputs.items()])


def null_safe(keys: Sequence[str]) -> Column:
    """Equality of the keys with their ``_of_`` counterparts, a null being equal to a null."""
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) if k != SLICE else F.col(k) == F.col(f"_of_{k}") for k in keys]
    return reduce(and_, same)


def with_position(df: DataFrame, by: Sequence[str], order: str, name: str = "pos", slices: int | None = None) -> DataFrame:
    """Add the 0-based position of each row within its group."""
    return running(df, by, order, {name: ("count", F.lit(1))}, inclusive=False, slices=slices)


def streaks(df: DataFrame, order: str, match: Column, name: str = "streak", slices: int | None = None) -> DataFrame:
    """Add how many rows up to this one, without a gap, fulfil ``match``; a null does."""
    rows = with_slices(df.withColumn("_miss", ~match), ordinal(order, df), slices)
    own = W.partitionBy(SLICE).orderBy(order)
    rows = rows.withColumn("_place", F.row_number().over(own))
    missed = F.max(F.when(F.col("_miss"), F.col("_place"))).over(own.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_missed", missed)
    ends = rows.groupBy(SLICE).agg(F.max("_place").alias("n"), F.max("_missed").alias("m"), F.lit(0).alias("_all"))
    earlier = W.partitionBy("_all").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    before = ends.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    last = F.coalesce(F.max(F.col("before") + F.col("m")).over(earlier), F.lit(0))
    carry = before.select(F.col(SLICE).alias(f"_of_{SLICE}"), (F.col("before") - last).alias("_run"))
    met = rows.join(carry, null_safe([SLICE]), "left")
    streak = F.coalesce(F.col("_place") - F.col("_missed"), F.col("_place") + F.col("_run"))
    return met.select(*df.columns, streak.alias(name))


def newest(df: DataFrame, by: Sequence[str], order: str, capacity: int, slices: int | None = None) -> DataFrame:
    """The ``capacity`` rows of each group that come last; slices wholly behind them are dropped by their counts."""
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    rows = with_slices(base, ordinal(order, base), slices)
    group = [*keys, SLICE]
    later = W.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    ahead = sizes.select(*group, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_newer")).where(F.col("_newer") < capacity)
    open_ = rows.join(ahead.withColumnsRenamed({k: f"_of_{k}" for k in group}), null_safe(group))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col(order).desc()))
    return open_.withColumn("_rank", rank).where(F.col("_rank") + F.col("_newer") <= capacity).select(*df.columns)


def with_blocks(df: DataFrame, position: str, reach: int, rows: int, before: bool) -> DataFrame:
    """Cut a gap-free position into blocks and copy the rows a neighbouring block's frame reaches.

    Adds ``_block`` and ``_own`` (false on copies). ``before`` says that frames
    look back by ``reach`` rows, otherwise they look ahead.
    """
    size = max(rows, reach + 1)
    block = F.floor(F.col(position) / F.lit(size))
    offset = F.col(position) % F.lit(size)
    if before:
        copies = F.when(offset >= size - reach, F.array(block, block + 1))
    else:
        copies = F.when((offset < reach) & (block > 0), F.array(block, block - 1))
    return df.withColumn("_block", F.explode(copies.otherwise(F.array(block)))).withColumn(
        "_own", F.col("_block") == block
    )
