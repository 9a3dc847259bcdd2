import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import assign as A
from tilewright.operators import grid as G
from tilewright.operators.cut_tree import cut_tree
from tilewright.operators.layout import layout_from_rects
from tilewright.operators.placement import place


def random_rects(n, nx, ny, seed):
    """Rectangles made by random cuts of random rectangles."""
    rng = random.Random(seed)
    rects = [(0, nx, 0, ny)]
    while len(rects) < n:
        k = rng.randrange(len(rects))
        c0, c1, r0, r1 = rects[k]
        ways = [w for w, room in ((0, c1 - c0), (1, r1 - r0)) if room > 1]
        if not ways:
            continue
        if rng.choice(ways):
            at = rng.randrange(r0 + 1, r1)
            rects[k] = (c0, c1, r0, at)
            rects.append((c0, c1, at, r1))
        else:
            at = rng.randrange(c0 + 1, c1)
            rects[k] = (c0, at, r0, r1)
            rects.append((at, c1, r0, r1))
    return rects


@pytest.fixture
def only_trees(monkeypatch):
    monkeypatch.setattr(A, "TABLE_ENTRIES", 0)


def test_tree_takes_layouts_apart():
    rects = random_rects(300, 64, 64, 1)
    tree = cut_tree([(pid, *r) for pid, r in enumerate(rects)])
    assert len(tree.boxes) == 300 and len(tree.line) == 299 and tree.depth < 40
    wheel = [(0, 0, 2, 0, 1), (1, 2, 3, 0, 2), (2, 1, 3, 2, 3), (3, 0, 1, 1, 3), (4, 1, 2, 1, 2)]
    assert cut_tree(wheel) is None
    assert cut_tree([(7, 0, 3, 0, 3)]).depth == 0


@pytest.mark.parametrize("missing", [(), (3, 17)])
def test_trees_and_tables_give_the_same_owners(spark, points, grid, monkeypatch, missing):
    rects = random_rects(40, grid.nx, grid.ny, 5)
    layout = layout_from_rects(spark, rects, grid).filter(~F.col("pid").isin(*missing)) if missing else layout_from_rects(spark, rects, grid)

    def results(layout):
        own = {(r.id, r.pid) for r in A.assign_partitions(points, layout, grid).collect()}
        circles = A.replicate_circles(A.buffer_points(points, 0.8), layout, grid)
        return own, {(r.id, r.pid) for r in circles.collect()}

    want = results(layout)
    monkeypatch.setattr(A, "TABLE_ENTRIES", 0)
    assert results(layout.select("*")) == want


def test_placed_joins_under_a_tree(spark, points, grid, brute, listed, only_trees):
    layout = layout_from_rects(spark, random_rects(30, grid.nx, grid.ny, 9), grid).filter("pid <> 4")
    placed = place(points, layout, grid, 100)
    assert placed.slots.owners[0].tree
    got = listed(placed.join(radius=0.6))
    assert len(got) == len(set(got)) and set(got) == brute(points, 0.6)
    placed.release()


def test_twenty_thousand_rectangles_are_assigned_without_a_shuffle(spark, points):
    fine = G.make_grid(G.bounding_box(points), 1000, 1000)
    rects = random_rects(20_000, 1000, 1000, 3)
    placed = A.assign_partitions(points, layout_from_rects(spark, rects, fine), fine)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    cells = G.assign_cells(points, fine).collect()
    pids = {r.id: r.pid for r in placed.collect()}
    for r in cells:
        c0, c1, r0, r1 = rects[pids[r.id]]
        assert c0 <= r.j < c1 and r0 <= r.i < r1
