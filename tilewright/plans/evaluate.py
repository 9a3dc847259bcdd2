"""Timing a layout under a workload of distance joins."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import ABORTED, METRES_PER_DEGREE, OK
from tilewright.operators.assign import only_layout
from tilewright.operators.evaluation import best_so_far, median_cost, workload_cost
from tilewright.operators.grid import Grid
from tilewright.operators.join import distance_join
from tilewright.operators.layout import LAYOUT_KEY
from tilewright.operators.placement import place
from tilewright.plans.search import search_layouts
from tilewright.session import local_table

# Budget of a query without a best time, and how far a run may exceed the best.
FIRST_BUDGET = 100000.0
ABORT_FACTOR = 2.0


def evaluate_layout(
    points: DataFrame, layout: DataFrame | None, workload: DataFrame, grid: Grid | None = None,
    best: Mapping[int, float] | None = None, trials: int = 3, rows_per_task: int | None = None,
) -> DataFrame:
    """trials(layout_id, qid, trial, seconds, status) of the workload's self-joins.

    The points are placed once; all queries and trials join them where they are. Each run writes
    its pairs to nowhere, so timing includes all of the join and nothing is gathered. A run that
    reaches twice the best time of its query is stopped there, marked aborted, and ends the
    evaluation. ``layout=None`` times the join without a layout, as layout -1.
    """
    budgets = dict(best or {})
    if layout is None:
        layout_id, kept = -1, points.select("id", "x", "y").persist(StorageLevel.MEMORY_AND_DISK)
        join, release = (lambda radius: distance_join(kept, kept, radius)), kept.unpersist
    else:
        layout_id = only_layout(layout, grid)
        placed = place(points, layout, grid, rows_per_task)
        kept, join, release = placed.points, (lambda radius: placed.join(radius=radius)), placed.release
    rows = []
    try:
        kept.count()
        for query in workload.select("qid", "distance").orderBy("qid").collect():
            pairs = join(query.distance / METRES_PER_DEGREE)
            limit = ABORT_FACTOR * budgets.get(query.qid, FIRST_BUDGET)
            for trial in range(trials):
                seconds, finished = timed(pairs, limit)
                rows.append((layout_id, query.qid, trial, seconds, OK if finished else ABORTED))
                if not finished:
                    return trial_table(points, rows)
    finally:
        release()
    return trial_table(points, rows)


def timed(pairs: DataFrame, limit: float) -> tuple[float, bool]:
    """Seconds a run takes, and whether it ended within ``limit`` seconds; its jobs are cancelled at that time."""
    context = pairs.sparkSession.sparkContext
    tag = f"trial-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(limit, stop)
    context.addJobTag(tag)
    start = time.perf_counter()
    timer.start()
    try:
        pairs.write.format("noop").mode("overwrite").save()
    except Exception:
        if not over.is_set():  # it failed by itself
            raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    seconds = time.perf_counter() - start
    return seconds, seconds <= limit and not over.is_set()


def search_and_evaluate(
    points: DataFrame, grid: Grid, workload: DataFrame, finalists: int = 3, trials: int = 3, **search,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search layouts, time the best ``finalists`` of them, keep the fastest.

    Returns the kept layout, evals(seq, layout_id, cost, status, best_before, improved, reward) and
    all trials. Each finalist runs against the times of the best one before it, so a slower
    one is aborted early. ``search`` goes to ``search_layouts``. If every finalist is
    aborted, the one with the lowest estimate is kept.
    """
    found = search_layouts(points, grid, workload, **search)
    spark = points.sparkSession
    budgets, best, rows, runs = None, (None, 0), [], None
    ids = sorted(r[0] for r in found.select(LAYOUT_KEY).distinct().collect())
    for seq, key in enumerate(ids[:finalists]):
        layout = found.filter(F.col(LAYOUT_KEY) == key).drop("cost")
        timed = evaluate_layout(points, layout, workload, grid, budgets, trials)
        costs = median_cost(timed)
        result = workload_cost(costs, workload).first()
        rows.append((seq, key, result.cost, result.status))
        runs = timed if runs is None else runs.unionByName(timed)
        if result.status == OK and (best[0] is None or result.cost < best[0]):
            best, budgets = (result.cost, key), as_budgets(costs)
    evals = best_so_far(local_table(spark, rows, "seq int, layout_id int, cost double, status string"))
    return found.filter(F.col(LAYOUT_KEY) == best[1]), evals, runs


def trial_table(points: DataFrame, rows: list) -> DataFrame:
    ddl = "layout_id int, qid int, trial int, seconds double, status string"
    return local_table(points.sparkSession, rows, ddl)


def as_budgets(costs: DataFrame) -> dict[int, float]:
    """Per-query seconds of one evaluated layout, as the budget for the next."""
    return {r.qid: r.seconds for r in costs.select("qid", "seconds").filter(F.col("seconds").isNotNull()).collect()}
