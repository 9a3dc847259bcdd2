import pytest
from pyspark.sql import functions as F

from tilewright.operators import grid as G
from tilewright.operators import join as J
from tilewright.operators import layout as L


@pytest.mark.parametrize("radius", [0.0, 0.05, 0.5, 3.0])
def test_self_join_matches_brute_force(points, radius, brute, listed):
    got = listed(J.distance_join(points, points, radius))
    assert len(got) == len(set(got))
    assert set(got) == brute(points, radius)


def test_two_sided_join(points, brute, listed):
    left, right = points.filter("id % 3 = 0"), points.filter("id % 3 = 1")
    got = listed(J.distance_join(left, right, 0.7))
    assert len(got) == len(set(got)) and set(got) == brute(left, 0.7, right)


@pytest.mark.parametrize("boundary", ["half_open", "closed"])
@pytest.mark.parametrize("rows_per_task", [10_000, 50])
def test_any_layout_gives_the_same_pairs(spark, points, grid, brute, listed, boundary, rows_per_task):
    layout = L.replay_cuts(spark, grid, [180, 209, 29, 360])
    for radius in (0.3, 2.5):
        got = listed(J.distance_join(points, points, radius, layout, grid, boundary, rows_per_task=rows_per_task))
        assert len(got) == len(set(got)) and set(got) == brute(points, radius)


def test_points_outside_the_grid_still_meet(spark, points, brute, listed):
    small = G.make_grid((5.0, 10.0, 0.5, 1.5), 4, 4)
    layout = L.replay_cuts(spark, small, [5, 16])
    got = listed(J.distance_join(points, points, 0.5, layout, small))
    assert len(got) == len(set(got)) and set(got) == brute(points, 0.5)


@pytest.mark.parametrize("hot_rows", [5, 40])
def test_crowded_cells_lose_and_repeat_nothing(spark, clumped, brute, listed, hot_rows):
    for radius in (0.01, 0.4):
        want = brute(clumped, radius)
        got = listed(J.distance_join(clumped, clumped, radius, hot_rows=hot_rows))
        assert len(got) == len(set(got)) and set(got) == want
    other = clumped.select("id", "x", "y")
    got = listed(J.distance_join(clumped, other, 0.4, hot_rows=hot_rows))
    assert len(got) == len(set(got)) and set(got) == want
    grid = G.make_grid(G.bounding_box(clumped), 8, 8)
    layout = L.replay_cuts(spark, grid, [9, 64])
    got = listed(J.distance_join(clumped, clumped, 0.4, layout, grid, hot_rows=hot_rows, rows_per_task=60))
    assert len(got) == len(set(got)) and set(got) == want


def test_crowded_cells_on_one_side_only(clumped, brute, listed):
    few = clumped.filter("id % 50 = 0").select("id", "x", "y")
    for left, right in ((few, clumped), (clumped, few)):
        got = listed(J.distance_join(left, right, 0.4, hot_rows=5))
        assert len(got) == len(set(got)) and set(got) == brute(left, 0.4, right)


def test_crowded_cells_are_found_and_spread(clumped):
    side = 0.4 * J.CELL_SLACK
    cells = J.prepare(clumped, side)
    hot, _ = J.crowded_cells(cells, None, 40)
    ways = {(r.cx, r.cy): (r.kp, r.kc) for r in hot.collect()}
    assert ways[1, 1][0] >= 400 // 40 and ways[1, 1][0] == ways[1, 1][1]
    few = cells.filter("id % 200 = 0")
    hot, _ = J.crowded_cells(cells, few, 40)
    ways = {(r.cx, r.cy): (r.kp, r.kc) for r in hot.collect()}
    assert ways[1, 1][0] >= 400 // 40 and ways[1, 1][1] == 1
    none, total = J.crowded_cells(cells, None, 50_000)
    assert none is None and total > 500


def test_many_crowded_cells_go_through_a_table(clumped, brute, listed, monkeypatch):
    monkeypatch.setattr(J, "collect_small", lambda df: None)
    got = listed(J.distance_join(clumped, clumped, 0.4, hot_rows=5))
    assert len(got) == len(set(got)) and set(got) == brute(clumped, 0.4)


def test_grouped_parts_cover_each_circle(clumped, brute):
    want = brute(clumped, 0.4)
    found = [sorted(map(tuple, J.distance_join_grouped(clumped, clumped, 0.4, hot_rows=h, max_ids=50).collect())) for h in (40, 50_000)]
    assert found[0] == found[1]
    got = [(c, p) for c, _, ids, _ in found[0] for p in ids]
    assert len(got) == len(set(got)) and set(got) == want
    for c, part, ids, n in found[0]:
        mine = sorted(p for a, p in want if a == c)
        assert n == len(mine) and ids == mine[50 * part : 50 * part + 50]
    plain = J.distance_join_grouped(clumped, clumped, 0.4).collect()
    assert {r.part for r in plain} == {0} and len(plain) == 600


def expected_parts(left, radius, max_ids, brute, right=None):
    lists = {}
    for c, p in sorted(brute(left, radius, right)):
        lists.setdefault(c, []).append(p)
    return [(c, k // max_ids, ids[k : k + max_ids], len(ids)) for c, ids in sorted(lists.items()) for k in range(0, len(ids), max_ids)]


def test_neighbour_lists_are_made_without_moving_pairs(points):
    near = J.distance_join_grouped(points, points, 0.5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    # Circles and points move once; the pairs are neither dealt by circle nor ranked in a window.
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2
    assert "Window" not in plan and "Sort " not in plan


@pytest.mark.parametrize("max_ids", [1, 4, 10_000])
def test_neighbour_lists_of_two_tables_and_layouts(spark, points, grid, brute, max_ids):
    layout = L.replay_cuts(spark, grid, [180, 209, 29, 360])
    left, right = points.filter("id % 3 = 0"), points.filter("id % 3 = 1")
    want = expected_parts(left, 0.5, max_ids, brute, right)
    for extra in ((), (layout, grid), (layout, grid, "closed")):
        got = J.distance_join_grouped(left, right, 0.5, *extra, rows_per_task=90, max_ids=max_ids).collect()
        assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("hot_rows", [5, 40])
def test_neighbour_lists_beside_crowded_cells(clumped, brute, hot_rows):
    few = clumped.filter("id % 50 = 0").select("id", "x", "y")
    for left, right in ((clumped, clumped), (few, clumped), (clumped, few)):
        got = J.distance_join_grouped(left, right, 0.4, hot_rows=hot_rows, max_ids=7, slice_rows=100).collect()
        assert sorted(map(tuple, got)) == expected_parts(left, 0.4, 7, brute, right)


def test_circles_with_one_id_share_their_list(spark, points):
    some = points.filter("id < 40")
    twice = some.unionByName(some.filter("id < 10")).unionByName(some.filter("id = 3").selectExpr("id", "x + 3 AS x", "y"))
    pairs = J.distance_join(twice, twice.select("id", "x", "y"), 2.0)
    want = sorted((r.circle_id, 0, sorted(r.ids), len(r.ids)) for r in pairs.groupBy("circle_id").agg(F.collect_list("point_id").alias("ids")).collect())
    assert sorted(map(tuple, J.distance_join_grouped(twice, twice, 2.0).collect())) == want


def test_plans_have_no_all_pairs_join(spark, points, grid):
    layout = L.replay_cuts(spark, grid, [180, 209, 29, 360])
    for df in (
        J.distance_join(points, points, 0.1),
        J.distance_join(points, points, 0.1, layout, grid),
        J.distance_join(points, points.filter("id > 5"), 0.1, hot_rows=100),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert plan.count("REPARTITION_BY_NUM") == 2 and "ShuffledHashJoin" in plan


def test_circle_squares(points):
    row = J.buffer_points(points, 0.5).first()
    assert (row.bx0, row.bx1, row.by0, row.by1) == (row.x - 0.5, row.x + 0.5, row.y - 0.5, row.y + 0.5)
    assert J.buffer_points(points, F.lit(2.0)).first().radius == 2.0


def crowd(spark, n):
    """Points scattered over a unit square by hashes, n of them, and two that are near nothing."""
    def at(k):
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_003)) / 100_003

    nowhere = spark.createDataFrame([(-1, float("nan"), 0.5), (-2, None, 0.5)], "id bigint, x double, y double")
    return spark.range(n).select("id", at(1).alias("x"), at(2).alias("y")).unionByName(nowhere)


def test_blocks_of_close_points_give_the_same_pairs(spark, brute, listed):
    points = crowd(spark, 900).cache()
    want = brute(points.filter("id >= 0"), 0.4)
    got = listed(J.distance_join(points, points, 0.4))
    assert len(got) == len(set(got)) and set(got) == want
    got = listed(J.distance_join(points.select("id", "x", "y"), points, 0.4))
    assert len(got) == len(set(got)) and set(got) == want


def bytes_per_row(pairs, folder):
    pairs.write.parquet(str(folder))
    return sum(f.stat().st_size for f in folder.glob("*.parquet")) / pairs.sparkSession.read.parquet(str(folder)).count()


def test_written_pairs_take_little_room(spark, tmp_path):
    points = crowd(spark, 3000).cache()
    assert bytes_per_row(J.distance_join(points, points, 0.3), tmp_path / "pairs") < 0.8


def test_written_pairs_of_a_layout_take_little_room(spark, tmp_path):
    points = crowd(spark, 3000).cache()
    grid = G.make_grid((0.0, 1.0, 0.0, 1.0), 4, 4)
    layout = L.replay_cuts(spark, grid, [5, 16])
    assert bytes_per_row(J.distance_join(points, points, 0.3, layout, grid), tmp_path / "pairs") < 0.9


def test_dense_points_are_dealt_over_many_tasks(spark, tmp_path):
    points = crowd(spark, 4000).cache()
    grid = G.make_grid((0.0, 1.0, 0.0, 1.0), 4, 4)
    layout = L.replay_cuts(spark, grid, [5])
    # All points lie in one tile of 8 x 8 cells; a task should get some 500 of them.
    for extra in ((), (layout, grid)):
        pairs = J.distance_join(points, points, 0.125, *extra, rows_per_task=500)
        folder = tmp_path / str(len(extra))
        pairs.write.parquet(str(folder))
        per_file = spark.read.parquet(str(folder)).groupBy(F.input_file_name()).agg(F.countDistinct("point_id").alias("n"))
        assert per_file.agg(F.max("n")).first()[0] < 2500 and per_file.agg(F.sum("n")).first()[0] >= 4000


def test_parts_of_a_list_are_cut_before_they_become_rows(spark, points):
    """No row of a part takes the whole list along, and no filter makes lists a second time to test their size."""
    found = J.distance_join_grouped(points, points, 0.5, max_ids=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    assert any("_parts#" in line for line in made)
    assert not any("ids#" in line.split("], ")[-2].split("[")[-1] for line in made)
    assert not [line for line in plan.splitlines() if "Filter" in line and "filter(" in line]
