from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewright.operators import grid as G
from tilewright.operators import layout as L
from tilewright.operators import placement as P
from tilewright.operators.ordered import with_rank
from tilewright.operators.placement import place
from tilewright.session import local_table

CUTS = [180, 209, 29, 360]


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows_per_task", [10_000, 100, 17])
def test_one_placement_serves_every_radius(spark, points, grid, brute, listed, rows_per_task):
    placed = place(points, L.replay_cuts(spark, grid, CUTS), grid, rows_per_task)
    for radius in (0.0, 0.05, 0.3, 2.5):
        got = listed(placed.join(radius=radius))
        assert len(got) == len(set(got)) and set(got) == brute(points, radius)
    placed.release()


@pytest.mark.parametrize("hot_rows", [5, 40])
def test_crowded_cells_of_a_placement(spark, clumped, brute, listed, hot_rows):
    grid = G.make_grid(G.bounding_box(clumped), 6, 6)
    placed = place(clumped, L.replay_cuts(spark, grid, [3 * 12, 7]), grid, 50)
    for radius in (0.01, 0.4):
        want = brute(clumped, radius)
        got = listed(placed.join(radius=radius, hot_rows=hot_rows))
        assert len(got) == len(want) and set(got) == want
    placed.release()


def test_circles_of_another_table(spark, points, grid, brute, listed):
    placed = place(points.filter("id % 3 = 1"), L.replay_cuts(spark, grid, CUTS), grid, 60)
    left = points.filter("id % 3 = 0")
    for hot_rows in (10, 100_000):
        got = listed(placed.join(left, 0.7, hot_rows=hot_rows))
        assert len(got) == len(set(got)) and set(got) == brute(left, 0.7, points.filter("id % 3 = 1"))
    placed.release()


@pytest.mark.parametrize("hot_rows", [20, 100_000])
def test_many_layouts_in_one_job(spark, points, grid, brute, hot_rows):
    layouts = L.replay_cuts(spark, grid, CUTS).unionByName(
        L.replay_cuts(spark, grid, [15, 900]).withColumn("layout_id", F.lit(4))
    )
    placed = place(points, layouts, grid, 90)
    want = brute(points, 0.4)
    got = [(r.layout_id, r.circle_id, r.point_id) for r in placed.join(radius=0.4, hot_rows=hot_rows).collect()]
    assert len(got) == 2 * len(want) and set(got) == {(k, *p) for k in (0, 4) for p in want}
    placed.release()


def test_points_outside_uncovered_and_without_coordinates(spark, points, brute, listed):
    small = G.make_grid((5.0, 10.0, 0.5, 1.5), 4, 4)
    hole = L.replay_cuts(spark, small, [5, 16]).filter("pid <> 1")
    odd = points.unionByName(local_table(spark, [(-1, None, 1.0), (-2, 2.0, None)], "id bigint, x double, y double"))
    placed = place(odd, hole, small, 200)
    got = listed(placed.join(radius=0.5))
    assert len(got) == len(set(got)) and set(got) == brute(points, 0.5)
    placed.release()


def test_no_points(spark, points, grid):
    placed = place(points.limit(0), L.replay_cuts(spark, grid, CUTS), grid)
    assert placed.join(radius=1.0).collect() == []
    placed.release()


def test_placed_points_do_not_move_again(spark, points, grid):
    placed = place(points, L.replay_cuts(spark, grid, CUTS), grid, 100)
    placed.points.count()
    for radius in (0.05, 0.3):
        pairs = placed.join(radius=radius)
        executed = pairs._jdf.queryExecution().executedPlan().toString()
        cached = executed.split("InMemoryRelation")[0]
        # One exchange, of the copied circles; the points of both joins and the circles that stay have none.
        assert executed.count("ShuffledHashJoin") == 2
        moved = [line for line in executed.splitlines() if "Exchange" in line and "Reused" not in line]
        outside = [line for line in moved if not inside_cache(executed, line)]
        assert len(outside) == 1 and "REPARTITION_BY" in outside[0], outside
        assert cached
    placed.release()


def test_tasks_do_not_follow_the_slots(spark, points, grid, brute, listed):
    """Slots of five points each share some tasks; every task reports to the driver."""
    placed = place(points, L.replay_cuts(spark, grid, CUTS), grid, 5)
    assert placed.slots.total >= 180 and placed.points.rdd.getNumPartitions() == 4 * 8
    got = listed(placed.join(radius=0.3))
    assert len(got) == len(set(got)) and set(got) == brute(points, 0.3)
    placed.release()


def counts_of(pairs):
    return sorted(Counter(c for c, _ in pairs).items())


@pytest.mark.parametrize("fine", [None, 3, 8, 32])
def test_counts_are_those_of_the_pairs(spark, points, clumped, grid, brute, monkeypatch, fine):
    """Neighbours are counted by cells wholly inside the circles; none is lost at their edges, beyond slots or in crowded cells."""
    if fine:
        monkeypatch.setattr(P, "fineness", lambda *_: fine)
    left = points.filter("id % 3 = 0")
    placed = place(points, L.replay_cuts(spark, grid, CUTS), grid, 100)
    assert sorted(map(tuple, placed.join(radius=2.5, counted=True).collect())) == counts_of(brute(points, 2.5))
    assert sorted(map(tuple, placed.join(left, 0.7, counted=True).collect())) == counts_of(brute(left, 0.7, points))
    placed.release()
    around = G.make_grid(G.bounding_box(clumped), 6, 6)
    layouts = L.replay_cuts(spark, around, [3 * 12, 7])
    placed = place(clumped, layouts.unionByName(layouts.withColumn("layout_id", F.lit(4))), around, 50)
    want = counts_of(brute(clumped, 0.4))
    got = sorted(map(tuple, placed.join(radius=0.4, hot_rows=20, counted=True).collect()))
    assert got == [(k, *w) for k in (0, 4) for w in want]
    placed.release()


def test_few_points_are_tested_where_neighbours_are_counted(spark):
    """In a dense square cells are small, and most cells a circle meets lie wholly inside it; a radius of one cell has none such."""
    at = F.col("id")
    dense = spark.range(10_000).select("id", (at % 100 / 50).alias("x"), (F.floor(at / 100) / 50).cast("double").alias("y"))
    fine = P.fineness(dense, 1.0)
    whole, edge = P.offsets(fine)
    assert 8 < fine <= P.FINEST and len(whole) > len(edge) and P.offsets(1) == ([], P.offsets(1)[1]) and len(P.offsets(1)[1]) == 9


def inside_cache(plan, line):
    """Whether a line of a plan belongs to the plan that filled a cache."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    k = lines.index(line)
    here = depth[k]
    for j in range(k - 1, -1, -1):
        if depth[j] < here:
            here = depth[j]
            if "InMemoryRelation" in lines[j]:
                return True
    return False


@pytest.mark.parametrize("ties", [1, 5, 1000])
def test_ranks_follow_the_order(spark, ties):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000 / ties).cast("int").alias("v"))
    got = with_rank(df, [F.col("v").desc()], "place").collect()
    assert sorted(r.place for r in got) == list(range(1000))
    by_place = [r.v for r in sorted(got, key=lambda r: r.place)]
    assert by_place == sorted(by_place, reverse=True)
    assert with_rank(df.limit(0), [F.col("v")]).collect() == []


def test_a_run_over_its_budget_is_stopped_there(spark, points):
    from tilewright.plans.evaluate import timed

    slow = spark.range(0, 1 << 40, 1, 8).selectExpr("sum(hash(id)) AS s")
    seconds, finished = timed(slow, 1.5)
    assert not finished and 1.4 < seconds < 20
    assert timed(points, 60.0)[1]
    with pytest.raises(Exception, match="wrong"):
        timed(points.selectExpr("raise_error('wrong')"), 60.0)


def test_a_slow_layout_costs_no_more_than_its_budget(spark, points, grid):
    from tilewright.plans.evaluate import evaluate_layout
    from tilewright.sources.vectors import workload_table

    layout = L.replay_cuts(spark, grid, CUTS)
    workload = workload_table(spark, [3.0e7, 1000.0], [0.5, 0.5])
    rows = evaluate_layout(points, layout, workload, grid, best={0: 0.01, 1: 50.0}).collect()
    assert [(r.qid, r.trial, r.status) for r in rows] == [(0, 0, "aborted")]
    fine = evaluate_layout(points, layout, workload, grid, best={0: 500.0, 1: 500.0}, trials=2).collect()
    assert [(r.qid, r.trial, r.status) for r in fine] == [(0, 0, "ok"), (0, 1, "ok"), (1, 0, "ok"), (1, 1, "ok")]


def test_written_pairs_of_two_layouts_take_little_room(spark, tmp_path):
    def at(k):
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_003)) / 100_003

    dense = spark.range(3000).select("id", at(1).alias("x"), at(2).alias("y")).cache()
    around = G.make_grid((0.0, 1.0, 0.0, 1.0), 4, 4)
    layout = L.replay_cuts(spark, around, [5, 16])
    placed = place(dense, layout.unionByName(layout.withColumn("layout_id", F.lit(4))), around)
    placed.join(radius=0.3).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    n = pairs.count()
    assert n == pairs.distinct().count() == 2 * placed.join(dense, 0.3).where("layout_id = 4").count()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) / n < 0.9
    placed.release()
