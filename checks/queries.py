"""One query per operator, over the given tables.

Points are the events: x is the time in days since 2024-01-01, y a tenth of the value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions.scalar import ABORTED, METRES_PER_DEGREE, OK, priority
from tilewright.operators import cuts as C
from tilewright.operators import evaluation as E
from tilewright.operators import experience as X
from tilewright.operators import grid as G
from tilewright.operators import join as J
from tilewright.operators import layout as L
from tilewright.operators.assign import (
    assign_partitions,
    buffer_points,
    fullest_partition,
    partition_by_layout,
    partition_stats,
    replicate_circles,
)
from tilewright.operators.medians import partition_medians
from tilewright.operators.placement import place
from tilewright.operators.scan import with_position
from tilewright.plans.estimate import estimate_cost, partition_loads
from tilewright.plans.greedy import greedy_layout, median_cut
from tilewright.plans.search import search_layouts, summed_area
from tilewright.session import shared_folder
from tilewright.sources.layouts import read_layout, write_layout
from tilewright.sources.points import read_points, spread_points
from tilewright.sources.tables import read_log, read_transitions, write_log, write_transitions
from tilewright.sources.vectors import read_costs, read_vector, workload_table, write_costs, write_vector

Query = Callable[[SparkSession, str], DataFrame]

# Two cut sequences that are legal on a 30 x 30 grid.
MIXED_CUTS = [41, 1240, 27, 47, 1166, 9, 1251]
EVEN_CUTS = [120, 240, 31, 360, 151, 47, 15]

FINE = 150
FINE_CUTS = [18000, 81, 18201, 22700]

RADIUS = 0.1
DISTANCES = [1100.0, 5500.0, 11000.0]
RATES = [0.25, 0.5, 0.25]
ABORT_PRICE = 300000.0

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (micros / F.lit(8.64e10)).alias("x"),
        (F.col("value") / 10).alias("y"),
    )


def event_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Grid]:
    points = event_points(spark, sf_dir)
    return points, G.make_grid(G.bounding_box(points))


def even_layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Grid, DataFrame]:
    points, grid = event_grid(spark, sf_dir)
    return points, grid, L.replay_cuts(spark, grid, EVEN_CUTS)


def workload(spark: SparkSession) -> DataFrame:
    return workload_table(spark, DISTANCES, RATES)


def listed(name: str) -> Column:
    return F.array_join(F.transform(name, lambda p: p.cast("string")), ",").alias(name)


def fine_layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Grid, DataFrame]:
    """Events on a coarse raster, so that many points coincide, under a layout of a 150 x 150 grid."""
    raster = [(F.floor(F.col(c) * 10) / 10).alias(c) for c in ("x", "y")]
    points = event_points(spark, sf_dir).select("id", *raster)
    grid = G.make_grid(G.bounding_box(points), FINE, FINE)
    return points, grid, L.replay_cuts(spark, grid, FINE_CUTS)


def rounded(name: str, places: int = 6) -> Column:
    return F.round(name, places).alias(name)


# --- sources and sinks, through the shared folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}/{name}"


@query
def q_points_roundtrip(spark, sf_dir):
    """Points written as several files, read with their ids and spread over a fixed number of partitions."""
    path = fresh_folder(spark, "points")
    event_points(spark, sf_dir).select("x", "y", "id").repartition(3, "id").write.csv(path)
    points = spread_points(read_points(spark, path, id_col="id"), 4)
    return points.select("id", rounded("x"), rounded("y"))


@query
def q_vector_roundtrip(spark, sf_dir):
    """Mean value of each user, the even users in one file and the odd ones in the next."""
    path = fresh_folder(spark, "vector")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    for half in (0, 1):
        write_vector(users.filter(F.col("user_id") % 2 == half), f"{path}/half={half}", "user_id", "mean")
    return read_vector(spark, f"{path}/half=*").select("idx", rounded("value"))


@query
def q_costs_roundtrip(spark, sf_dir):
    """Median cost per query over all layouts, and the blank file of a stopped run."""
    costs = E.median_cost(trials(spark, sf_dir)).groupBy("qid").agg(F.max("seconds").alias("seconds"))
    path, stopped = fresh_folder(spark, "costs"), fresh_folder(spark, "stopped")
    write_costs(costs, path)
    write_costs(costs.withColumn("status", F.when(F.col("qid") == 2, ABORTED).otherwise(OK)), stopped)
    both = [read_costs(spark, p).select(F.lit(k).alias("run"), "qid", rounded("seconds"), "status") for k, p in enumerate((path, stopped))]
    return both[0].unionByName(both[1])


@query
def q_layout_roundtrip(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    path = fresh_folder(spark, "layout")
    write_layout(layout, path)
    back = partition_stats(points, read_layout(spark, path, grid), grid)
    return back.select("pid", "c0", "c1", "r0", "r1", *[rounded(c) for c in ("min_x", "max_x", "min_y", "max_y")], "n")


@query
def q_log_roundtrip(spark, sf_dir):
    path = fresh_folder(spark, "log")
    write_log(X.episode_totals(transitions(spark, sf_dir)), path)
    return read_log(spark, path, "episode bigint, reward double").select("episode", rounded("reward"))


@query
def q_transitions_roundtrip(spark, sf_dir):
    """The demonstrations of a written experience table; the folder of the other rows is not read."""
    path = fresh_folder(spark, "memory")
    write_transitions(transitions(spark, sf_dir), path)
    return read_transitions(spark, path, is_demo=True).select("episode", "step", rounded("reward"), "done", "is_demo")


# --- points, grid, cells


@query
def q_bbox(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return G.bounding_box(points).select(*map(rounded, ("min_x", "max_x", "min_y", "max_y")))


@query
def q_bbox_compat(spark, sf_dir):
    points = event_points(spark, sf_dir)
    box = G.bounding_box(points, compat=True)
    return box.select(*map(rounded, ("min_x", "max_x", "min_y", "max_y")))


@query
def q_grid_lines(spark, sf_dir):
    _, grid = event_grid(spark, sf_dir)
    return G.grid_lines(spark, grid).select("axis", "idx", rounded("value"))


@query
def q_point_cells(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return G.assign_cells(points, grid).select("id", "i", "j")


@query
def q_grid_histogram(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return G.grid_histogram(points, grid).select("i", "j", "n", rounded("density"))


@query
def q_grid_histogram_closed(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return G.grid_histogram(points, grid, "closed").select("i", "j", "n", rounded("density"))


@query
def q_cell_weight(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return G.cell_weight(G.grid_histogram(points, grid)).select("i", "j", rounded("weight"))


@query
def q_minmax_scale(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return G.minmax_scale(points, "y", 0.0, 1.0).select("id", rounded("scaled"))


@query
def q_nearest_line(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    near = G.nearest_line(points, grid, "x", F.col("x"), F.lit(1), F.lit(grid.nx - 1))
    return near.select("id", "line")


# --- layouts and cuts


def root_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal cuts of the root with the number of points below each cut line."""
    points, grid = event_grid(spark, sf_dir)
    cuts = L.legal_cuts(L.root_layout(spark, grid), grid)
    sums = summed_area(G.cell_counts(points, grid), grid)
    at_i = F.when(F.col("dir") == 0, F.col("i")).otherwise(grid.ny)
    at_j = F.when(F.col("dir") == 1, F.col("j")).otherwise(grid.nx)
    wanted = cuts.withColumns({"at_i": at_i, "at_j": at_j})
    below = sums.select(
        F.col("i").alias("at_i"), F.col("j").alias("at_j"), F.col("total").alias("n_low")
    )
    return wanted.join(below, ["at_i", "at_j"]).drop("at_i", "at_j")


@query
def q_root_cuts(spark, sf_dir):
    return root_cuts(spark, sf_dir)


@query
def q_layout_cuts(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    stats = partition_stats(points, layout, grid).select("pid", "n")
    return L.legal_cuts(layout, grid).join(stats, "pid")


@query
def q_replay_layout(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    layout = partition_stats(points, L.replay_cuts(spark, grid, MIXED_CUTS), grid)
    edges = [rounded(c) for c in ("min_x", "max_x", "min_y", "max_y")]
    return layout.select("pid", "c0", "c1", "r0", "r1", *edges, "n")


@query
def q_apply_cuts(spark, sf_dir):
    """Every legal cut of the root applied to its own copy, with the point counts that result."""
    points, grid = event_grid(spark, sf_dir)
    cuts = L.legal_cuts(L.root_layout(spark, grid), grid)
    chosen = cuts.select(F.col("action").alias("layout_id"), "action")
    roots = chosen.select(
        "layout_id", *[F.lit(v).alias(c) for c, v in dict(pid=0, c0=0, c1=grid.nx, r0=0, r1=grid.ny).items()]
    )
    made = L.apply_cuts(L.with_coordinates(roots, grid), chosen, grid)
    return partition_stats(points, made, grid).select("layout_id", "pid", "c0", "c1", "r0", "r1", "n")


@query
def q_median_cut_1(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    cut = median_cut(points, L.root_layout(spark, grid), grid)
    return cut.select("pid", "dir", "i", "j", "action")


@query
def q_greedy_layout(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return greedy_layout(points, grid).select("pid", "c0", "c1", "r0", "r1", "n", rounded("share"))


@query
def q_cell_owner(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    cells = G.cell_counts(points, grid)
    return L.cell_owner(layout).join(cells, ["i", "j"]).select("i", "j", "pid", "n")


@query
def q_raster(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    cells = G.cell_weight(G.grid_histogram(points, grid))
    raster = L.layout_raster(cells, partition_stats(points, layout, grid), grid)
    flags = [F.col(c).cast("int").alias(c) for c in ("h_line", "v_line")]
    return raster.select("i", "j", *flags, rounded("weight"))


@query
def q_same_layout(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return L.layout_difference(greedy_layout(points, grid), L.replay_cuts(spark, grid, MIXED_CUTS))


@query
def q_best_cut(spark, sf_dir):
    """The most even cut of the root; cuts with an empty side are not legal here."""
    cuts = root_cuts(spark, sf_dir)
    total = event_points(spark, sf_dir).agg(F.count("*")).scalar()
    n = F.col("n_low")
    scored = cuts.withColumns({"legal": (n > 0) & (n < total), "score": -F.abs(n * 2 - total)})
    return C.best_cut(scored).select("action", "score")


@query
def q_shift_cut(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    cuts = L.legal_cuts(layout, grid)
    chosen = median_cut(points, layout, grid)
    moved = [
        C.shift_cut(cuts, chosen, 2, grid.nx, mode).withColumn("mode", F.lit(mode))
        for mode in ("anchor", "line")
    ]
    return moved[0].unionByName(moved[1]).select("mode", "action", "shift", "shifted")


@query
def q_random_cut(spark, sf_dir):
    _, grid, layout = even_layout(spark, sf_dir)
    return C.random_cut(L.legal_cuts(layout, grid), seed=7)


@query
def q_search_layouts(spark, sf_dir):
    points, grid = event_grid(spark, sf_dir)
    return search_layouts(points, grid, workload(spark)).select(
        "layout_id", "pid", "c0", "c1", "r0", "r1", "cost"
    )


@query
def q_search_two_parts(spark, sf_dir):
    """A search without chance that keeps all layouts of two parts: every cut of the root by its cost."""
    points, grid = event_grid(spark, sf_dir)
    found = search_layouts(points, grid, workload(spark), max_partitions=2, beam=64, eps_random=0.0, eps_shift=0.0)
    return found.select("layout_id", "pid", "c0", "c1", "r0", "r1", rounded("cost"))


# --- partitions


@query
def q_assign_partitions(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return assign_partitions(points, layout, grid).select("id", "pid")


@query
def q_partition_stats(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return partition_stats(points, layout, grid).select("pid", "n", rounded("share"))


@query
def q_partition_stats_closed(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return partition_stats(points, layout, grid, "closed").select("pid", "n", rounded("share"))


@query
def q_partition_medians(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    medians = partition_medians(points, layout, grid)
    return medians.select("pid", rounded("median_x"), rounded("median_y"))


@query
def q_fullest_partition(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return fullest_partition(partition_stats(points, layout, grid)).select("pid", "n")


@query
def q_circles_per_partition(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    circles = replicate_circles(buffer_points(points, RADIUS), layout, grid)
    return circles.groupBy("pid").agg(F.count("*").alias("m"))


@query
def q_assign_closed_fine(spark, sf_dir):
    points, grid, layout = fine_layout(spark, sf_dir)
    return assign_partitions(points, layout, grid, "closed").select("id", "pid")


@query
def q_partition_medians_closed_fine(spark, sf_dir):
    points, grid, layout = fine_layout(spark, sf_dir)
    medians = partition_medians(points, layout, grid, "closed")
    return medians.select("pid", rounded("median_x"), rounded("median_y"))


@query
def q_circles_fine(spark, sf_dir):
    points, grid, layout = fine_layout(spark, sf_dir)
    circles = replicate_circles(buffer_points(points, RADIUS), layout, grid)
    return circles.groupBy("pid").agg(F.count("*").alias("m"))


@query
def q_partition_by_layout(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return partition_by_layout(points, layout, grid).select("id", "pid")


# --- distance joins


@query
def q_distance_join(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return J.distance_join(points, points, RADIUS)


@query
def q_distance_join_layout(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return J.distance_join(points, points, RADIUS, layout, grid)


@query
def q_distance_join_grouped(spark, sf_dir):
    points = event_points(spark, sf_dir)
    matches = J.distance_join_grouped(points, points, RADIUS)
    return matches.select("circle_id", "part", listed("point_ids"), "n")


@query
def q_distance_join_grouped_parts(spark, sf_dir):
    points = event_points(spark, sf_dir)
    matches = J.distance_join_grouped(points, points, RADIUS, max_ids=4)
    return matches.select("circle_id", "part", listed("point_ids"), "n")


@query
def q_distance_join_two_sided(spark, sf_dir):
    """Circles around purchases, points of all events; cells of more than 100 rows are split."""
    points = event_points(spark, sf_dir)
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    return J.distance_join(points.join(bought, "id", "left_semi"), points, RADIUS, hot_rows=100)


@query
def q_metres_join(spark, sf_dir):
    """Neighbours of each circle in the self-join at 5000 metres."""
    points = event_points(spark, sf_dir)
    pairs = J.distance_join(points, points, 5000.0 / METRES_PER_DEGREE)
    return pairs.groupBy("circle_id").agg(F.count("*").alias("n"))


RADII = [0.02, RADIUS, 0.5]


def two_layouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Grid, DataFrame]:
    points, grid, even = even_layout(spark, sf_dir)
    mixed = L.replay_cuts(spark, grid, MIXED_CUTS).withColumn("layout_id", F.lit(1))
    return points, grid, even.unionByName(mixed)


@query
def q_distance_join_placed(spark, sf_dir):
    """Neighbours of each circle for three radii, all joined with points placed once."""
    points, grid, layout = even_layout(spark, sf_dir)
    placed = place(points, layout, grid, counted=True)
    found = [placed.join(radius=r, counted=True).select(F.lit(r).alias("radius"), "circle_id", "n") for r in RADII]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def q_distance_join_placed_split(spark, sf_dir):
    """The same pairs with every partition in several slots and crowded cells split, circles from purchases."""
    points, grid, layout = even_layout(spark, sf_dir)
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    circles = points.join(bought, "id", "left_semi")
    return place(points, layout, grid, rows_per_task=200).join(circles, RADIUS, hot_rows=100)


@query
def q_distance_join_two_layouts(spark, sf_dir):
    points, grid, layouts = two_layouts(spark, sf_dir)
    return place(points, layouts, grid).join(radius=RADIUS)


@query
def q_distance_join_hub(spark, sf_dir):
    """One circle that reaches all points, ranked in slices of 100 ids, in parts of 64."""
    points = event_points(spark, sf_dir)
    hub = points.filter("id = 7")
    matches = J.distance_join_grouped(hub, points, 1000.0, max_ids=64, slice_rows=100)
    return matches.select("circle_id", "part", listed("point_ids"), "n")


@query
def q_median_cuts_two_layouts(spark, sf_dir):
    points, grid, layouts = two_layouts(spark, sf_dir)
    return median_cut(points, layouts, grid).select("layout_id", "pid", "dir", "i", "j", "action")


# --- costs


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trial times: nine order keys make one layout of three queries with three trials each.

    Many runs are aborted, and layouts with all three queries aborted occur.
    """
    key = F.col("o_orderkey")
    place = key % 9
    return table(spark, sf_dir, "orders").select(
        F.floor(key / 9).cast("int").alias("layout_id"),
        F.floor(place / 3).cast("int").alias("qid"),
        (place % 3).cast("int").alias("trial"),
        (F.col("o_totalprice") / 1000).alias("seconds"),
        F.when(F.col("o_totalprice") > ABORT_PRICE, ABORTED).otherwise(OK).alias("status"),
    )


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    costs = E.median_cost(trials(spark, sf_dir))
    evals = E.workload_cost(costs, workload(spark)).withColumn("seq", F.col("layout_id"))
    return costs, evals


@query
def q_median_trials(spark, sf_dir):
    costs = E.median_cost(trials(spark, sf_dir))
    return costs.select("layout_id", "qid", rounded("seconds"))


@query
def q_workload_cost(spark, sf_dir):
    _, evals = evaluated(spark, sf_dir)
    return evals.select("layout_id", rounded("cost", 8), "status")


@query
def q_total_query_time(spark, sf_dir):
    return E.total_query_time(trials(spark, sf_dir)).select(F.round("seconds", 3).alias("seconds"))


@query
def q_best_so_far(spark, sf_dir):
    _, evals = evaluated(spark, sf_dir)
    marked = E.best_so_far(evals)
    return marked.select(
        "seq", rounded("cost", 8), rounded("best_before", 8), "improved", rounded("reward")
    )


@query
def q_best_costs(spark, sf_dir):
    costs, evals = evaluated(spark, sf_dir)
    return E.best_costs_so_far(costs, evals).select("seq", "qid", rounded("budget"))


@query
def q_improvements(spark, sf_dir):
    _, evals = evaluated(spark, sf_dir)
    return E.improvement_count(E.best_so_far(evals)).select("seq", "improvements")


@query
def q_estimate_cost(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    return partition_loads(points, layout, workload(spark), grid).select("qid", "pid", "n", "m", "load")


@query
def q_layout_cost(spark, sf_dir):
    points, grid, layout = even_layout(spark, sf_dir)
    costs = [
        estimate_cost(points, layout, workload(spark), grid, how).select(
            F.lit(how).alias("how"), rounded("cost")
        )
        for how in ("max", "sum")
    ]
    return costs[0].unionByName(costs[1])


# --- experience and logs


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transitions: a user is an episode, events in time order are its steps."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    steps = with_position(events, ["user_id"], "ts", "step")
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts")).withColumn("last", F.lit(True))
    rows = steps.join(last, ["user_id", "ts"], "left")
    return rows.select(
        F.col("user_id").alias("episode"),
        "step",
        (F.col("value") / 100).alias("reward"),
        F.coalesce("last", F.lit(False)).alias("done"),
        (F.col("event_type") == "purchase").alias("is_demo"),
        (F.col("value") / 100).alias("td_error"),
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored rows with a priority each."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        priority(F.col("value") / 100).alias("priority"),
        (F.col("event_type") == "purchase").alias("is_demo"),
    )


def even_draws(df: DataFrame, k: int = 32) -> DataFrame:
    """Draws spread evenly over the total priority."""
    total = df.agg(F.sum("priority")).scalar()
    return df.sparkSession.range(k).select(
        F.col("id").alias("draw"), (total * (F.col("id") + 0.5) / k).alias("s")
    )


@query
def q_nstep(spark, sf_dir):
    steps = X.nstep_return(transitions(spark, sf_dir), 3, 0.99)
    return steps.select("episode", "step", rounded("nstep_reward", 8))


@query
def q_nstep_state(spark, sf_dir):
    """The state of a step is the value of its event; the next one is what the step leads to."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("value") / 100).alias("reward"))
    ahead = Window.partitionBy("user_id").orderBy("ts")
    steps = with_position(events, ["user_id"], "ts", "step").select(
        F.col("user_id").alias("episode"),
        "step",
        "reward",
        F.lead("ts").over(ahead).isNull().alias("done"),
        F.array(F.lead("reward").over(ahead)).alias("next_state"),
    )
    made = X.nstep_return(steps, 3, 0.99)
    state = F.round(F.get("next_state", F.lit(0)), 6)
    return made.select("episode", "step", rounded("nstep_reward", 8), state.alias("next_state"))


@query
def q_rolling_mean(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return X.rolling_mean(events, "event_id", "value", 10).select("event_id", rounded("rolling_mean"))


@query
def q_streak(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.match_streak(events, "event_id", F.col("event_type") != "error", 10).select("event_id", "streak")


@query
def q_retain_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.retain_latest(events, 1000, ["event_type"], "event_id")


@query
def q_every_kth(spark, sf_dir):
    logs = X.episode_totals(transitions(spark, sf_dir))
    return X.every_kth(logs, "episode", 10).select("episode", rounded("reward"))


@query
def q_episode_totals(spark, sf_dir):
    logs = X.episode_totals(transitions(spark, sf_dir))
    return logs.select("episode", rounded("reward"))


@query
def q_priority(spark, sf_dir):
    return memory(spark, sf_dir).select("idx", rounded("priority"))


@query
def q_initial_priority(spark, sf_dir):
    rows = X.initial_priority(memory(spark, sf_dir), order="idx")
    return rows.select("idx", rounded("initial_priority"))


@query
def q_weighted_lookup(spark, sf_dir):
    rows = memory(spark, sf_dir)
    return X.weighted_lookup(even_draws(rows), rows).select("draw", "idx", rounded("priority"))


@query
def q_weighted_lookup_heavy(spark, sf_dir):
    """One row outweighs all others together by far; draws lie before, in and behind it."""
    rows = memory(spark, sf_dir).withColumn("priority", F.when(F.col("idx") == 300, 1e12).otherwise(F.round("priority", 3)))
    far = even_draws(rows)
    near = spark.range(64).select((F.col("id") + 100).alias("draw"), (F.col("id") * 2.5 + 0.3).alias("s"))
    return X.weighted_lookup(far.unionByName(near), rows).select("draw", "idx", rounded("priority"))


@query
def q_priority_weights(spark, sf_dir):
    rows = memory(spark, sf_dir)
    hits = X.sample_at(rows, even_draws(rows), capacity=10_000, progress=0.5)
    return hits.select("draw", "idx", rounded("weight"))


@query
def q_update_priorities(spark, sf_dir):
    rows = memory(spark, sf_dir)
    errors = table(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.col("event_id").alias("idx"), (F.col("value") / 10).alias("td_error")
    )
    return X.update_priorities(rows, errors).select("idx", rounded("priority"))


@query
def q_route_transitions(spark, sf_dir):
    """Episodes with a lower total than all before them count as improved."""
    steps = transitions(spark, sf_dir)
    totals = X.episode_totals(steps).select(
        "episode", F.col("episode").alias("seq"), F.col("reward").alias("cost"), F.lit(OK).alias("status")
    )
    return X.route_transitions(steps, E.best_so_far(totals)).select("episode", "step", "is_demo")


@query
def q_sample_k(spark, sf_dir):
    return X.sample_k(memory(spark, sf_dir), 32, seed=7, key="idx").select("idx", rounded("priority"), "weight")


@query
def q_priority_sample(spark, sf_dir):
    drawn = X.priority_sample(memory(spark, sf_dir), 32, capacity=10_000, progress=0.5, seed=7)
    return drawn.select("draw", "idx", rounded("priority"), rounded("weight"))


@query
def q_mixed_batch(spark, sf_dir):
    rows = memory(spark, sf_dir)
    batch = X.mixed_batch(rows.filter("is_demo"), rows.filter("NOT is_demo"), progress=0.5, seed=7)
    return batch.select("source", "idx", rounded("priority"), rounded("weight"))
