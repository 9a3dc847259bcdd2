"""Costs of layouts under a workload, and records over the sequence of evaluated layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import ABORTED, OK, reward
from tilewright.operators.layout import LAYOUT_KEY
from tilewright.operators.medians import MEDIAN_ROWS, grouped_median
from tilewright.operators.scan import running


def median_cost(trials: DataFrame, limit: int = MEDIAN_ROWS) -> DataFrame:
    """costs(layout_id, qid, seconds): median trial time, null for a query with an aborted trial."""
    keys = [LAYOUT_KEY, "qid"]
    aborted = trials.filter(F.col("status") == ABORTED).select(*keys).distinct()
    finished = trials.select(*keys, "seconds").join(aborted, keys, "left_anti")
    stopped = aborted.select(*keys, F.lit(None).cast("double").alias("seconds"))
    return grouped_median(finished, keys, ["seconds"], limit).unionByName(stopped)


def workload_cost(costs: DataFrame, workload: DataFrame) -> DataFrame:
    """(layout_id, cost, status) of every layout in ``costs``: seconds weighted by rate.

    Null and aborted when a query of the workload has no time.
    """
    queries = workload.agg(F.count("*")).scalar()
    weighted = costs.join(workload.select("qid", "rate"), "qid", "left").groupBy(LAYOUT_KEY).agg(
        F.sum(F.col("seconds") * F.col("rate")).alias("total"), F.count(F.col("seconds") * F.col("rate")).alias("done")
    )
    complete = F.col("done") == queries
    return weighted.select(
        LAYOUT_KEY,
        F.when(complete, F.col("total")).alias("cost"),
        F.when(complete, F.lit(OK)).otherwise(F.lit(ABORTED)).alias("status"),
    )


def total_query_time(trials: DataFrame) -> DataFrame:
    """One row with the seconds spent over all runs."""
    return trials.agg(F.sum("seconds").alias("seconds"))


def best_so_far(evals: DataFrame, slices: int | None = None) -> DataFrame:
    """Add best_before, improved and reward to evals(seq, layout_id, cost, status).

    The first finished layout is the baseline: it has nothing to improve on and
    its reward is 1. Aborted layouts never count as best.
    """
    cost = F.when(F.col("status") != ABORTED, F.col("cost"))
    seen = running(evals, [], "seq", {"best_before": ("min", cost)}, inclusive=False, slices=slices)
    best = F.coalesce("best_before", "cost")
    improved = F.coalesce((F.col("status") != ABORTED) & (F.col("cost") < F.col("best_before")), F.lit(False))
    return seen.withColumns(
        {"improved": improved, "reward": reward(best, F.col("cost"), F.col("status"))}
    )


def best_costs_so_far(costs: DataFrame, evals: DataFrame, slices: int | None = None) -> DataFrame:
    """(seq, layout_id, qid, budget): per query, the seconds of the best layout before this one.

    ``costs`` has one row per evaluated layout and query. Null until a baseline exists.
    """
    marked = best_so_far(evals, slices)
    leads = F.col("improved") | (F.col("best_before").isNull() & (F.col("status") != ABORTED))
    rows = costs.select(LAYOUT_KEY, "qid", "seconds").join(
        marked.select("seq", LAYOUT_KEY, leads.alias("leads")), LAYOUT_KEY
    )
    seconds = F.when(F.col("leads"), F.col("seconds"))
    return running(
        rows, ["qid"], "seq", {"budget": ("last", seconds)}, inclusive=False, slices=slices
    ).select("seq", LAYOUT_KEY, "qid", "budget")


def improvement_count(marked: DataFrame, slices: int | None = None) -> DataFrame:
    """Add the number of improvements up to and including each evaluated layout."""
    hit = F.col("improved").cast("bigint")
    return running(marked, [], "seq", {"improvements": ("sum", hit)}, slices=slices)
