"""Headline timings as one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from checks.queries import DISTANCES, RATES, event_points
from tilewright.operators import grid as G
from tilewright.operators.assign import partition_stats
from tilewright.operators.evaluation import median_cost, workload_cost
from tilewright.operators.join import distance_join, distance_join_grouped
from tilewright.operators.medians import partition_medians
from tilewright.operators.placement import place
from tilewright.plans.estimate import estimate_cost
from tilewright.plans.evaluate import evaluate_layout
from tilewright.plans.greedy import greedy_layout
from tilewright.plans.search import search_layouts
from tilewright.sources.vectors import workload_table

TRIALS = 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def sent_once(points: DataFrame, layout: DataFrame, grid: G.Grid) -> DataFrame:
    """Placed points that nothing keeps, for timing what placing costs."""
    made = place(points, layout, grid)
    made.release()
    return made.points


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    points = event_points(spark, sf_dir)
    grid = G.make_grid(G.bounding_box(points))
    workload = workload_table(spark, DISTANCES, RATES)
    layout = greedy_layout(points, grid)
    radii = {"001": 0.01, "005": 0.05, "01": 0.1}
    jobs = {
        "grid_histogram": lambda: run(G.grid_histogram(points, G.make_grid(G.bounding_box(points)))),
        "greedy_layout": lambda: run(greedy_layout(points, grid)),
        "partition_stats": lambda: run(partition_stats(points, layout, grid)),
        "partition_medians": lambda: run(partition_medians(points, layout, grid)),
        "estimate_cost": lambda: run(estimate_cost(points, layout, workload, grid)),
        "search_layouts": lambda: run(search_layouts(points, grid, workload)),
        "distance_join_grouped_01": lambda: run(distance_join_grouped(points, points, 0.1)),
    }
    for label, radius in radii.items():
        jobs[f"distance_join_{label}"] = lambda r=radius: run(distance_join(points, points, r))
        jobs[f"distance_join_greedy_{label}"] = lambda r=radius: run(
            distance_join(points, points, r, layout, grid)
        )

    # Points placed once; every radius joins them where they are.
    placed = place(points, layout, grid)
    placed.points.count()
    jobs["place"] = lambda: run(sent_once(points, layout, grid))
    for label, radius in radii.items():
        jobs[f"distance_join_placed_{label}"] = lambda r=radius: run(placed.join(radius=r))

    timings = {}
    for name, job in jobs.items():
        job()
        seconds = []
        for _ in range(TRIALS):
            start = time.perf_counter()
            job()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds), 4)

    # The workload protocol: median of three runs over cached points per radius, weighted by rate.
    arms = {
        "none": None,
        "greedy": layout,
        "searched": search_layouts(points, grid, workload).filter("layout_id = 0").drop("cost"),
    }
    for arm, chosen in arms.items():
        trials = evaluate_layout(points, chosen, workload, grid)
        cost = workload_cost(median_cost(trials), workload).first().cost
        timings[f"workload_{arm}"] = round(cost, 4)

    total = round(sum(timings.values()), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
