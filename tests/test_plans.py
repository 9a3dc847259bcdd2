import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries import event_points
from tests.conftest import DATA
from tilewright.operators import grid as G
from tilewright.operators import layout as L
from tilewright.operators.assign import partition_stats
from tilewright.operators.medians import grouped_median, partition_medians
from tilewright.plans.estimate import estimate_cost, partition_loads
from tilewright.plans.evaluate import as_budgets, evaluate_layout, search_and_evaluate
from tilewright.plans.greedy import greedy_layout, greedy_steps, median_cut
from tilewright.plans.search import search_layouts, summed_area
from tilewright.sources.vectors import workload_table

# Known answers for the event points on a 30 x 30 grid with 8 partitions.
GREEDY = {
    "sf0.001": ([180, 209, 29, 360, 388, 43, 15], [119, 130, 123, 120, 136, 138, 125, 109]),
    "sf0.01": ([120, 240, 31, 360, 151, 47, 15], [1130, 1270, 1336, 1286, 1372, 1221, 1131, 1254]),
    "sf0.1": ([120, 31, 240, 47, 17, 151, 360], [13939, 12757, 13915, 11713, 12321, 12290, 12587, 10478]),
}


@pytest.mark.parametrize("sf", GREEDY)
def test_greedy_layout_known_answers(spark, sf):
    points = event_points(spark, f"{DATA}/{sf}")
    rects, counts, actions = greedy_steps(points, G.make_grid(G.bounding_box(points)))
    assert (actions, counts) == GREEDY[sf]
    assert sum((c1 - c0) * (r1 - r0) for c0, c1, r0, r1 in rects) == 900


def by_hand(xy, grid, n, closed):
    """The greedy layout straight from its definition, over all points in memory."""
    lines = {a: [grid.line(a, k) for k in range(m + 1)] for a, m in (("x", grid.nx), ("y", grid.ny))}
    rects, actions = [(0, grid.nx, 0, grid.ny)], []

    def inside(rect):
        c0, c1, r0, r1 = rect

        def keep(v, axis, lo, hi, m):
            top = v <= lines[axis][hi] if closed or hi == m else v < lines[axis][hi]
            return (v >= lines[axis][lo]) & top

        return xy[keep(xy[:, 0], "x", c0, c1, grid.nx) & keep(xy[:, 1], "y", r0, r1, grid.ny)]

    while len(rects) < n:
        sizes = [len(inside(r)) for r in rects]
        k = sizes.index(max(sizes))
        c0, c1, r0, r1 = rects[k]
        rows = inside(rects[k])
        tall = lines["y"][r1] - lines["y"][r0] > lines["x"][c1] - lines["x"][c0]
        axis, lo, hi = ("y", r0, r1) if tall else ("x", c0, c1)
        if hi - lo < 2 or not len(rows):
            break
        median = statistics.median(rows[:, 1 if tall else 0].tolist())
        line = min(range(lo + 1, hi), key=lambda q: (abs(lines[axis][q] - median), q))
        if tall:
            rects[k], new = (c0, c1, r0, line), (c0, c1, line, r1)
            actions.append(2 * (line * grid.nx + c0))
        else:
            rects[k], new = (c0, line, r0, r1), (line, c1, r0, r1)
            actions.append(2 * (r0 * grid.nx + line) + 1)
        rects.append(new)
    return rects, actions


@pytest.mark.parametrize("boundary", ["half_open", "closed"])
@pytest.mark.parametrize("seed", range(2))
def test_greedy_on_points_that_sit_on_lines(spark, boundary, seed):
    """Whole and half numbers put many points on lines, half way between them, and at equal medians."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.integers(0, 17, (40, 2)) / 2.0, rng.integers(0, 9, (21, 2)) * 1.0])
    xy = np.concatenate([xy, [[0.0, 0.0], [8.0, 8.0]]])
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    grid = G.make_grid((0.0, 8.0, 0.0, 8.0), 8, 8)
    rects, counts, actions = greedy_steps(points, grid, 7, boundary)
    assert (rects, actions) == by_hand(xy, grid, 7, boundary == "closed")
    layout = L.layout_from_rects(spark, rects, grid)
    stats = partition_stats(points, layout, grid, boundary).orderBy("pid").collect()
    assert [s.n for s in stats] == counts


def test_greedy_stops_when_the_fullest_cannot_be_cut(spark):
    points = spark.range(50).select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    grid = G.make_grid((0.0, 4.0, 0.0, 4.0), 4, 4)
    rects, counts, _ = greedy_steps(points, grid, 8)
    assert max(counts) == 50 and rects[counts.index(50)] == (0, 1, 0, 1) and len(rects) < 8
    assert median_cut(points, L.layout_from_rects(spark, rects, grid), grid).count() == 0


def test_greedy_layout_table(spark, points, grid):
    layout = greedy_layout(points, grid, 5)
    rows = layout.orderBy("pid").collect()
    assert [r.pid for r in rows] == list(range(5)) and sum(r.n for r in rows) == 1000
    assert abs(sum(r.share for r in rows) - 1) < 1e-9


@pytest.mark.parametrize("limit", [20, 200])
def test_large_groups_get_the_same_median(spark, points, limit):
    rows = points.select((F.col("id") % 3).alias("g"), "x", F.when(F.col("id") % 2 == 0, 1.5).otherwise(F.col("y")).alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(7, 1.0, 2.0), (7, 2.0, 5.0)], rows.schema))
    want = {r.g: (r.x, r.y) for r in rows.groupBy("g").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    got = {r.g: (r.x, r.y) for r in grouped_median(rows, ["g"], ["x", "y"], limit).collect()}
    assert got == want


def test_empty_partition_has_zero_medians(spark, points, grid):
    layout = L.replay_cuts(spark, grid, [2 * 29 * 30])  # the top row holds few points
    low = points.filter(F.col("y") < 1)
    rows = {r.pid: (r.median_x, r.median_y) for r in partition_medians(low, layout, grid).collect()}
    assert rows[1] == (0.0, 0.0) and rows[0] != (0.0, 0.0)


def test_summed_area(spark, points, grid):
    cells = {(r.i, r.j): r.n for r in G.cell_counts(points, grid).collect()}
    sums = {(r.i, r.j): r.total for r in summed_area(G.cell_counts(points, grid), grid).collect()}
    assert len(sums) == 31 * 31 and sums[30, 30] == 1000
    for i, j in ((0, 5), (7, 3), (30, 12), (4, 30)):
        assert sums[i, j] == sum(n for (a, b), n in cells.items() if a < i and b < j)


@pytest.fixture(scope="module")
def workload(spark):
    return workload_table(spark, [1100.0, 5500.0, 11000.0], [0.25, 0.5, 0.25])


def test_loads_of_many_layouts_at_once(spark, points, grid, workload):
    one = L.replay_cuts(spark, grid, [120, 240], 3)
    two = one.unionByName(L.replay_cuts(spark, grid, [31], 5))
    single = partition_loads(points, one, workload, grid)
    both = partition_loads(points, two, workload, grid)
    columns = ["layout_id", "qid", "pid", "n", "m", "load"]
    assert L.same_layout(single, both.filter("layout_id = 3"), columns)
    assert both.count() == 15


def test_search_finds_the_best_single_cut(spark, points, grid, workload):
    """With one cut to make, the search must rank all cuts as their estimate from whole cells does."""
    found = search_layouts(points, grid, workload, max_partitions=2, beam=3, eps_random=0, eps_shift=0)
    best = found.orderBy("layout_id").collect()
    assert [r.cost for r in best] == sorted(r.cost for r in best) and len(best) == 6
    cuts = L.legal_cuts(L.root_layout(spark, grid), grid).select(F.col("action").alias("layout_id"), "action")
    copies = L.root_layout(spark, grid).drop("layout_id").crossJoin(cuts.select("layout_id"))
    exact = estimate_cost(points, L.apply_cuts(copies, cuts, grid), workload, grid)
    lowest = exact.agg(F.min("cost")).first()[0]
    # Whole cells overstate the copies a little, never the other way.
    assert lowest <= best[0].cost <= lowest * 1.05


@pytest.mark.parametrize("how", ["max", "sum"])
def test_search_beats_or_meets_greedy(spark, points, grid, workload, how):
    layouts = search_layouts(points, grid, workload, 4, how=how, seed=3)
    if how == "max":
        again = search_layouts(points, grid, workload, 4, how=how, seed=3)
        assert L.same_layout(layouts, again, layouts.columns)
    owners = L.cell_owner(layouts).groupBy("layout_id").agg(
        F.count("*").alias("cells"), F.countDistinct("i", "j").alias("places"), F.countDistinct("pid").alias("parts")
    )
    assert {(r.cells, r.places, r.parts) for r in owners.collect()} == {(900, 900, 4)}
    best = estimate_cost(points, layouts.filter("layout_id = 0").drop("cost"), workload, grid, how).first().cost
    greedy = estimate_cost(points, greedy_layout(points, grid, 4), workload, grid, how).first().cost
    assert best <= greedy * 1.02


def test_search_costs_are_exact_whatever_the_histogram(spark, points, grid, workload):
    for cells in (900, 50_000):
        found = search_layouts(points, grid, workload, 3, beam=4, seed=1, histogram_cells=cells)
        costs = {r.layout_id: r.cost for r in found.collect()}
        exact = estimate_cost(points, found.drop("cost"), workload, grid).collect()
        assert costs == {r.layout_id: r.cost for r in exact} and sorted(costs.values()) == [costs[k] for k in range(4)]


def test_search_and_evaluate_keeps_the_fastest(points, grid, workload):
    best, evals, trials = search_and_evaluate(points, grid, workload, finalists=2, trials=2, max_partitions=2, beam=2)
    rows = sorted(evals.collect(), key=lambda r: r.seq)
    done = [r for r in rows if r.status == "ok"]
    assert [r.layout_id for r in rows] == [0, 1] and rows[0].status == "ok" and rows[0].reward == 1.0
    assert {r.layout_id for r in best.collect()} == {min(done, key=lambda r: r.cost).layout_id}
    assert {r.layout_id for r in trials.collect()} == {0, 1}


def test_evaluation_runs_and_aborts(spark, points, grid, workload):
    layout = L.replay_cuts(spark, grid, [180, 209], 4)
    trials = evaluate_layout(points, layout, workload, grid, trials=2).collect()
    assert [(t.qid, t.trial) for t in trials] == [(q, k) for q in range(3) for k in range(2)]
    assert {t.status for t in trials} == {"ok"} and {t.layout_id for t in trials} == {4}
    stopped = evaluate_layout(points, layout, workload, grid, best={0: 1e9, 1: 0.0}, trials=2).collect()
    assert [(t.qid, t.status) for t in stopped] == [(0, "ok"), (0, "ok"), (1, "aborted")]
    none = evaluate_layout(points, None, workload, trials=1)
    assert {t.layout_id for t in none.collect()} == {-1}
    assert set(as_budgets(none.select("qid", "seconds"))) == {0, 1, 2}
