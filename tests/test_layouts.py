import pytest
from pyspark.sql import functions as F

from checks.oracle import apply_by_hand
from tilewright.operators import cuts as C
from tilewright.operators import grid as G
from tilewright.operators import layout as L
from tilewright.operators.assign import (
    assign_partitions,
    buffer_points,
    fullest_partition,
    partition_by_layout,
    partition_stats,
    replicate_circles,
)
from tilewright.session import local_table

CUTS = [41, 1240, 27, 47, 1166, 9, 1251]

# The layout those cuts give on this box.
BOX = (-124.84701, -66.88805, 24.43357, 49.38418)
EDGES = [
    (-124.84701, -117.11914866666666, 24.43357, 49.38418),
    (-86.20770333333334, -80.41180733333334, 24.43357, 41.067310000000006),
    (-86.20770333333334, -76.54787666666667, 41.067310000000006, 49.38418),
    (-99.73146066666666, -86.20770333333334, 24.43357, 40.235623000000004),
    (-80.41180733333334, -66.88805, 24.43357, 41.067310000000006),
    (-99.73146066666666, -86.20770333333334, 40.235623000000004, 49.38418),
    (-117.11914866666666, -99.73146066666666, 24.43357, 49.38418),
    (-76.54787666666667, -66.88805, 41.067310000000006, 49.38418),
]


def rects(df):
    return [(r.c0, r.c1, r.r0, r.r1) for r in df.orderBy("pid").collect()]


def test_replay_gives_the_known_layout(spark):
    grid = G.make_grid(BOX)
    rows = L.replay_cuts(spark, grid, CUTS).orderBy("pid").collect()
    assert [(r.min_x, r.max_x, r.min_y, r.max_y) for r in rows] == EDGES
    assert sum((r.c1 - r.c0) * (r.r1 - r.r0) for r in rows) == 900


def test_replay_equals_cut_by_cut(spark):
    grid = G.make_grid(BOX)
    layout = L.root_layout(spark, grid)
    for action in CUTS:
        layout = L.apply_cut(layout, action, grid)
    assert L.same_layout(layout, L.replay_cuts(spark, grid, CUTS))
    assert rects(layout) == [tuple(r) for r in apply_by_hand(CUTS)]


def test_a_cut_that_splits_nothing_fails(spark):
    grid = G.make_grid(BOX)
    with pytest.raises(Exception, match="splits no partition"):
        L.replay_cuts(spark, grid, [41, 41]).collect()


def test_legal_cut_counts(spark):
    grid = G.make_grid(BOX)
    root = L.root_layout(spark, grid)
    assert L.legal_cuts(root, grid).count() == 58
    assert L.legal_cuts(L.apply_cut(root, 41, grid), grid).count() == 86
    layout = L.replay_cuts(spark, grid, CUTS)
    expected = sum((c1 - c0 - 1) + (r1 - r0 - 1) for c0, c1, r0, r1 in rects(layout))
    assert L.legal_cuts(layout, grid).count() == expected


def test_single_cell_has_no_cut(spark):
    grid = G.make_grid((0, 1, 0, 1), 1, 1)
    assert L.legal_cuts(L.root_layout(spark, grid), grid).count() == 0


def test_every_legal_cut_tiles_the_grid(spark):
    grid = G.make_grid((0, 10, 0, 10), 5, 4)
    base = L.replay_cuts(spark, grid, [5])
    cuts = L.legal_cuts(base, grid)
    chosen = cuts.select(F.col("action").alias("layout_id"), "action")
    copies = base.drop("layout_id").crossJoin(chosen.select("layout_id"))
    owners = L.cell_owner(L.apply_cuts(copies, chosen, grid))
    sizes = owners.groupBy("layout_id").agg(
        F.count("*").alias("cells"), F.countDistinct("i", "j").alias("places"), F.countDistinct("pid").alias("parts")
    )
    assert {(r.cells, r.places, r.parts) for r in sizes.collect()} == {(20, 20, 3)}
    assert sizes.count() == cuts.count()


def test_layouts_without_a_cut_stay(spark):
    grid = G.make_grid((0, 10, 0, 10), 4, 4)
    both = L.root_layout(spark, grid, 0).unionByName(L.root_layout(spark, grid, 1)).drop("share")
    cut = local_table(spark, [(1, 5)], "layout_id int, action int")
    sizes = {r.layout_id: r["count"] for r in L.apply_cuts(both, cut, grid).groupBy("layout_id").count().collect()}
    assert sizes == {0: 1, 1: 2}


def test_half_open_assigns_once_and_closed_repeats_shared_lines(spark):
    grid = G.make_grid((0, 4, 0, 4), 4, 4)
    layout = L.replay_cuts(spark, grid, [5, 16])  # x = 2, then the left part at y = 2
    rows = [(0, 2.0, 2.0), (1, 0.0, 2.0), (2, 4.0, 4.0), (3, 1.0, 1.0), (4, 2.0, 3.0), (5, 9.0, -9.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    half = {(r.id, r.pid) for r in assign_partitions(points, layout, grid).collect()}
    assert half == {(0, 1), (1, 2), (2, 1), (3, 0), (4, 1), (5, 1)}
    dropped = assign_partitions(points, layout, grid, outside="drop")
    assert dropped.filter("id = 5").count() == 0
    closed = {(r.id, r.pid) for r in assign_partitions(points, layout, grid, "closed", "drop").collect()}
    assert closed == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (3, 0), (4, 1), (4, 2)}
    counts = {r.pid: r.n for r in partition_stats(points, layout, grid, "closed").collect()}
    assert counts == {0: 3, 1: 3, 2: 3}


def test_join_path_agrees_with_lookup(spark, points, grid):
    """Two layouts in one table go through the owner join; one layout through the lookup."""
    one = L.replay_cuts(spark, grid, CUTS, 0)
    two = one.unionByName(L.replay_cuts(spark, grid, [120, 240, 31], 1))
    for boundary in ("half_open", "closed"):
        single = partition_stats(points, one, grid, boundary).select("pid", "n")
        both = partition_stats(points, two, grid, boundary).filter("layout_id = 0").select("pid", "n")
        assert L.same_layout(single, both, ["pid", "n"])
        circles = buffer_points(points, 0.7)
        a = replicate_circles(circles, one, grid, boundary).select("id", "pid")
        b = replicate_circles(circles, two, grid, boundary).filter("layout_id = 0").select("id", "pid")
        assert L.same_layout(a, b, ["id", "pid"])
    a = assign_partitions(points, one, grid).select("id", "pid")
    b = assign_partitions(points, two, grid).filter("layout_id = 0").select("id", "pid")
    assert L.same_layout(a, b, ["id", "pid"])


def test_partition_by_layout_keeps_rectangles_apart(spark, points, grid):
    layout = L.replay_cuts(spark, grid, [120, 240, 31, 360])
    for limit in (10_000, 100):
        moved = partition_by_layout(points, layout, grid, limit)
        plan = moved._jdf.queryExecution().toString()
        assert "shufflepartitionidpassthrough" in plan
        tasks = moved.groupBy(F.spark_partition_id().alias("t")).agg(
            F.countDistinct("pid").alias("pids"), F.count("*").alias("n")
        ).collect()
        assert all(t.pids == 1 for t in tasks) and sum(t.n for t in tasks) == 1000
    assert max(t.n for t in tasks) < 200


def test_fullest_partition_ties_go_to_the_lowest_pid(spark):
    stats = local_table(spark, [(0, 0, 5), (0, 1, 7), (0, 2, 7)], "layout_id int, pid int, n bigint")
    assert fullest_partition(stats).first().pid == 1


def test_choosing_cuts(spark):
    scored = local_table(
        spark, [(0, 4, 1.0, True), (0, 2, 1.0, True), (0, 1, 9.0, False), (1, 3, -1.0, True)],
        "layout_id int, action int, score double, legal boolean",
    )
    assert {(r.layout_id, r.action) for r in C.best_cut(scored).collect()} == {(0, 2), (1, 3)}
    grid = G.make_grid(BOX)
    cuts = L.legal_cuts(L.root_layout(spark, grid), grid)
    first = C.random_cut(cuts, 1).first()
    assert first == C.random_cut(cuts, 1).first()
    picks = {C.random_cut(cuts, seed).first().action for seed in range(6)}
    assert len(picks) > 1 and picks <= {r.action for r in cuts.collect()}


def test_shifted_cuts(spark):
    grid = G.make_grid(BOX)
    cuts = L.legal_cuts(L.root_layout(spark, grid), grid)
    chosen = local_table(spark, [(0, 41)], "layout_id int, action int")  # vertical at column 20
    by_line = {r.shift: r.shifted for r in C.shift_cut(cuts, chosen, 2, 30, "line").collect()}
    assert by_line == {-2: 37, -1: 39, 1: 43, 2: 45}
    by_anchor = {r.shift: r.shifted for r in C.shift_cut(cuts, chosen, 1, 30).collect()}
    assert by_anchor == {-1: 41, 1: 41}
    # After a cut, an anchored shift can land in another partition.
    layout = L.replay_cuts(spark, grid, [2 * 30])  # row 1
    low = local_table(spark, [(0, 41)], "layout_id int, action int")
    moved = {r.shift: r.shifted for r in C.shift_cut(L.legal_cuts(layout, grid), low, 1, 30).collect()}
    assert moved == {-1: 41, 1: 41 + 60}


def test_raster_of_the_root(spark, points, grid):
    cells = G.cell_weight(G.grid_histogram(points, grid))
    raster = {(r.i, r.j): r for r in L.layout_raster(cells, L.root_layout(spark, grid), grid).collect()}
    assert len(raster) == 31 * 31
    assert sum(r.h_line for r in raster.values()) == 60 and sum(r.v_line for r in raster.values()) == 60
    assert max(r.weight for r in raster.values()) == 1.0
    assert all(raster[30, j].weight == 0 for j in range(31))
