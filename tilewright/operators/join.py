"""Distance joins: all (circle, point) pairs within a radius.

The distance test becomes an equi-join on cells a little wider than the radius.
Both sides move once, keyed by a tile of cells or by the partitions
of a layout; the neighbouring cells of a circle are listed only after that
move, inside its task. There both sides become blocks of rows that lie close together, and pairs are
made block by block, so that written pairs hold runs and repeats and take little room. Cells that hold too many rows for one task take a second
path in which both sides are salted, so their pairs are made by many tasks.

Neighbour lists are made where the circles are: points are copied to the tasks of the circles they
may meet, and each circle picks its neighbours from the candidates of its cell, so no pair moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators.assign import (
    JOIN_ROWS,
    PAIR_ROWS,
    assign_partitions,
    buffer_points,
    placement,
    replicate_circles,
    slot_of,
)
from tilewright.operators.grid import Grid
from tilewright.operators.scan import above
from tilewright.session import collect_small, cut_lineage, local_table, shuffle_slots

# Join cells are wider than the radius by this factor, so that rounding in the
# cell index cannot separate a pair that passes the distance test.
CELL_SLACK = 1.0001

# A tile is 8 x 8 join cells, or 4 x 4, 2 x 2 or one where pairs are made and points are dense.
TILE_SHIFT = 3

# Rows one join cell may hold before it is split over several tasks: a tile of full cells is one task's share.
HOT_ROWS = JOIN_ROWS >> (2 * TILE_SHIFT)

# Rows of a cell that a join pairs as a whole. A multiple of eight, the values that a column file packs into whole bytes.
BLOCK = 64

# Neighbours in one row of a grouped result.
MAX_IDS = 10_000


def join_cell(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(side))


def tile_of(cell: Column, shift: int = TILE_SHIFT) -> Column:
    return F.shiftright(cell, shift)


def tile_shift(sides: Sequence[DataFrame], most: int) -> tuple[int, int]:
    """Size of a tile, as a shift of cells, at which the fullest holds at most ``most`` rows, and the points of a task.

    A task gets whole tiles, so this bounds its rows however dense they lie; rows are taken to
    be spread evenly over the cells of a tile. Small tiles get more copies of circles, whose ids
    share the dictionary of a written column with those of the points, so their tasks get
    fewer points. It steers only where pairs are made.
    """

    def copies(shift: int) -> float:
        cells = 1 << shift
        return (cells + 2) * (cells + 1) / cells**2

    shift = TILE_SHIFT
    for side in sides:
        tiles = with_own_tile(side.where("cx IS NOT NULL AND cy IS NOT NULL")).groupBy("tx", "ty").count()
        fullest = tiles.agg(F.max("count").alias("n")).first().n or 0
        while shift > 0 and fullest > most << 2 * (TILE_SHIFT - shift):
            shift -= 1
    return shift, max(1, int(most * copies(TILE_SHIFT) / copies(shift)))


def prepare(df: DataFrame, side: float) -> DataFrame:
    """Only the columns the join needs, plus the join cell."""
    return df.select(
        "id", "x", "y",
        join_cell(F.col("x"), side).alias("cx"),
        join_cell(F.col("y"), side).alias("cy"),
    )


def crowded_cells(points: DataFrame, circles: DataFrame | None, hot_rows: int) -> tuple[DataFrame | None, int]:
    """Join cells with more than ``hot_rows`` points or circles, as hot(cx, cy, kp, kc), and the row count.

    ``kp`` and ``kc`` say how many ways the points and the circles of the cell are split; without
    ``circles`` (a self-join) they are equal. Cell sizes come from rows picked by a hash of
    their id, about 100 per full cell, so the check moves little and gives the same answer every
    time. It steers only where pairs are made; every pair is made either way. The rows
    not picked form one group, whose size tells how large the table is.
    """
    step = max(1, hot_rows // 100)
    picked = F.pmod(F.xxhash64("id"), F.lit(step)) == 0

    def sizes(side: DataFrame, of_points: bool) -> DataFrame:
        counted = side.groupBy(F.when(picked, F.col("cx")).alias("cx"), F.when(picked, F.col("cy")).alias("cy"))
        n = F.count("*")
        return counted.agg((n if of_points else n * 0).alias("np"), (n * 0 if of_points and circles is not None else n).alias("nc"))

    both = sizes(points, True) if circles is None else sizes(points, True).unionByName(sizes(circles, False))

    def ways(n: str) -> Column:
        return F.greatest(F.ceil(F.max(n) * step / F.lit(hot_rows)), F.lit(1)).cast("bigint")

    listed = both.groupBy("cx", "cy").agg(
        ways("np").alias("kp"), ways("nc").alias("kc"), F.greatest(F.max("np"), F.max("nc")).alias("n")
    )
    rest = F.col("cx").isNull()
    listed = listed.filter(rest | (F.col("kp") > 1) | (F.col("kc") > 1))
    rows = collect_small(listed)
    if rows is None:
        hot = cut_lineage(listed.filter(~rest).select("cx", "cy", "kp", "kc"))
        return hot, (listed.filter(rest).first() or listed.first()).n
    total = sum(r.n for r in rows if r.cx is None)
    cells = [(r.cx, r.cy, r.kp, r.kc) for r in rows if r.cx is not None]
    if not cells:
        return None, total
    return local_table(points.sparkSession, cells, "cx bigint, cy bigint, kp bigint, kc bigint"), total


def neighbour_rows(circles: DataFrame, mirrored: bool, clip: bool, shift: int = TILE_SHIFT) -> DataFrame:
    """List the cells (gx, gy) a circle reaches.

    ``mirrored`` lists only its own cell and the four that follow it, enough
    for a self-join. ``clip`` keeps to the cells of the tile this copy was sent to.
    """
    cx, cy, tx, ty = (F.col(c) for c in ("cx", "cy", "tx", "ty"))
    last = F.lit((1 << shift) - 1)
    base_x, base_y = F.shiftleft(tx, shift), F.shiftleft(ty, shift)

    def cells(low, high, base):
        if clip:
            low, high = F.greatest(low, base), F.least(high, base + last)
            return F.when(low <= high, F.sequence(low, high))
        return F.sequence(low, high)

    rows = cells(cy if mirrored else cy - 1, cy + 1, base_y)
    listed = circles.withColumn("gy", F.explode(rows))
    left_end = F.when(F.col("gy") == cy, cx).otherwise(cx - 1) if mirrored else cx - 1
    return listed.withColumn("gx", F.explode(cells(left_end, cx + 1, base_x)))


def match(
    circles: DataFrame, points: DataFrame, keys: list[str], radius: float, mirrored: bool, keep: Sequence[str] = ()
) -> DataFrame:
    """Equi-join on cell keys, distance test, and both orders of each pair of a self-join; ``keep`` lists keys to keep."""
    c = circles.select(*keys, *[F.col(n).alias(f"c_{n}") for n in ("id", "x", "y", "cx", "cy")])
    p = points.select(*keys, *[F.col(n).alias(f"p_{n}") for n in ("id", "x", "y")])
    dx, dy = F.col("c_x") - F.col("p_x"), F.col("c_y") - F.col("p_y")
    near = dx * dx + dy * dy <= F.lit(radius * radius)
    if not mirrored:
        return c.join(p, keys).filter(near).select(*keep, F.col("c_id").alias("circle_id"), F.col("p_id").alias("point_id"))
    other_cell = (F.col("gx") != F.col("c_cx")) | (F.col("gy") != F.col("c_cy"))
    found = c.join(p, keys).filter(near & (other_cell | (F.col("c_id") <= F.col("p_id"))))

    def pair(a, b):
        return F.struct(F.col(f"{a}_id").alias("circle_id"), F.col(f"{b}_id").alias("point_id"))

    both = F.when(F.col("c_id") == F.col("p_id"), F.array(pair("c", "p"))).otherwise(
        F.array(pair("c", "p"), pair("p", "c"))
    )
    return found.select(*keep, F.explode(both).alias("pair")).select(*keep, "pair.*")


def in_blocks(rows: DataFrame, keys: Sequence[str], side: float) -> DataFrame:
    """Rows of each cell in blocks of ``BLOCK`` that lie close together, with their bounding box.

    A cell is walked in strips, up one and down the next, and cut every ``BLOCK`` rows. A point that has no
    number as a coordinate is near nothing and is left out.
    """
    known = rows.where(~F.isnan("x") & ~F.isnan("y"))
    cells = known.groupBy(*keys, "cx", "cy").agg(F.collect_list(F.struct("id", "x", "y")).alias("_all"))
    strips = F.greatest(F.lit(1), F.round(F.sqrt(F.size("_all") / F.lit(BLOCK))).cast("int"))

    def walked(m: Column) -> Column:
        strip = F.floor((m["x"] / F.lit(side) - F.col("cx")) * F.col("_strips"))
        return F.struct(strip.alias("strip"), F.when(strip % 2 == 0, m["y"]).otherwise(-m["y"]).alias("step"), m["id"].alias("id"), m["x"].alias("x"), m["y"].alias("y"))

    walk = cells.withColumn("_strips", strips).withColumn("_all", F.sort_array(F.transform("_all", walked)))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(BLOCK))
    cut = walk.withColumn("_start", F.explode(starts)).withColumn("block", F.slice("_all", F.col("_start"), F.lit(BLOCK)))

    def ends(v: str) -> list[Column]:
        values = F.transform("block", lambda m: m[v])
        return [F.array_min(values).alias(f"{v}0"), F.array_max(values).alias(f"{v}1")]

    members = F.transform("block", lambda m: F.struct(m["id"].alias("id"), m["x"].alias("x"), m["y"].alias("y")))
    return cut.select(*keys, "cx", "cy", members.alias("block"), *ends("x"), *ends("y"))


def match_blocks(
    circles: DataFrame, points: DataFrame, keys: list[str], radius: float, mirrored: bool, keep: Sequence[str] = ()
) -> DataFrame:
    """The pairs of ``match`` for blocks of both sides, written block by block.

    A block of points follows for each circle of a block in the same order, so the columns of the pairs
    hold long runs and repeats. Blocks too far from each other are left out, and of two blocks that are
    wholly near no points are tested.
    """
    box = ("block", "x0", "x1", "y0", "y1")
    c = circles.select(*keys, F.col("cx").alias("c_cx"), F.col("cy").alias("c_cy"), *[F.col(n).alias(f"c_{n}") for n in box])
    p = points.select(*keys, *[F.col(n).alias(f"p_{n}") for n in box])

    def ahead(v: str) -> tuple[Column, Column]:
        return F.col(f"c_{v}0") - F.col(f"p_{v}1"), F.col(f"p_{v}0") - F.col(f"c_{v}1")

    def square(dx: Column, dy: Column) -> Column:
        return dx * dx + dy * dy

    gap = square(*(F.greatest(*ahead(v), F.lit(0.0)) for v in "xy"))
    span = square(*(F.greatest(F.col(f"c_{v}1") - F.col(f"p_{v}0"), F.col(f"p_{v}1") - F.col(f"c_{v}0")) for v in "xy"))
    most = F.lit(radius * radius)
    own = (F.col("gx") == F.col("c_cx")) & (F.col("gy") == F.col("c_cy"))
    met = c.join(p, keys).where(gap <= most).withColumns({"whole": span <= most, "own": own})

    def order(a: str, b: str) -> Column:
        return F.struct(F.col(f"{a}_block").alias("a"), F.col(f"{b}_block").alias("b"))

    # Circles of a cell meet all points of it, so both orders of such a pair are found anyway.
    orders = F.array(order("c", "p"))
    if mirrored:
        orders = F.when(own, orders).otherwise(F.array(order("c", "p"), order("p", "c")))
    first = met.select(*keep, "whole", "own", F.explode(orders).alias("o"))
    second = first.select(*keep, "whole", "own", F.explode("o.a").alias("a"), F.col("o.b").alias("b"))
    each = second.select(*keep, "whole", "own", "a", F.explode("b").alias("b"))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    near = F.col("whole") | (dx * dx + dy * dy <= most)
    if mirrored:
        near = near & (~F.col("own") | (F.col("a.id").isNotNull() & F.col("b.id").isNotNull()))
    return each.where(near).select(*keep, F.col("a.id").alias("circle_id"), F.col("b.id").alias("point_id"))


def tile_moves(
    circles: DataFrame, points: DataFrame, mirrored: bool, total: int, rows_per_task: int | None, shift: int = TILE_SHIFT
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Send each point to the task of its tile and each circle to the tiles its cells lie in."""
    slots = max(shuffle_slots(points.sparkSession), -(-total // (rows_per_task or JOIN_ROWS)))
    slot = F.pmod(F.xxhash64("tx", "ty"), F.lit(slots)).cast("int")
    return (
        with_tiles(circles, mirrored, shift).withColumn("slot", slot).repartitionById(slots, F.col("slot")),
        with_own_tile(points, shift).withColumn("slot", slot).repartitionById(slots, F.col("slot")),
        ["slot"],
    )


def with_own_tile(points: DataFrame, shift: int = TILE_SHIFT) -> DataFrame:
    return points.withColumns({"tx": tile_of(F.col("cx"), shift), "ty": tile_of(F.col("cy"), shift)})


def with_tiles(circles: DataFrame, mirrored: bool, shift: int = TILE_SHIFT) -> DataFrame:
    """One row per tile the listed cells of a circle lie in, usually one."""
    cx, cy = F.col("cx"), F.col("cy")
    low_y = cy if mirrored else cy - 1
    return circles.withColumn(
        "tx", F.explode(F.sequence(tile_of(cx - 1, shift), tile_of(cx + 1, shift)))
    ).withColumn("ty", F.explode(F.sequence(tile_of(low_y, shift), tile_of(cy + 1, shift))))


def layout_moves(
    circles: DataFrame, points: DataFrame, mirrored: bool, radius: float, layout: DataFrame,
    grid: Grid, boundary: str, rows_per_task: int | None, most: int = JOIN_ROWS,
    shift: int = TILE_SHIFT,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Send each point to its partition and each circle to every partition it may reach.

    A partition fuller than a task's share is spread over several tasks by tile.
    """
    reach = buffer_points(circles, radius * CELL_SLACK)
    circles = with_tiles(
        replicate_circles(reach, layout, grid, boundary).select(*circles.columns, "pid"), mirrored, shift
    )
    points = with_own_tile(
        assign_partitions(points, layout, grid, boundary).select(*points.columns, "pid"), shift
    )
    tile_hash = F.xxhash64("tx", "ty")
    first, slots, total = placement(points, layout, grid, rows_per_task, most)
    slot = slot_of(tile_hash, first, slots)
    return (
        circles.withColumn("slot", slot).repartitionById(total, F.col("slot")),
        points.withColumn("slot", slot).repartitionById(total, F.col("slot")),
        ["slot", "pid"],
    )


def crowded_pairs(
    circles: DataFrame, points: DataFrame, hot: DataFrame, radius: float, mirrored: bool,
    reach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs whose point lies in a crowded cell. ``reach`` lists the cells of a circle, by default its own and those around it.

    Such a cell is a board of kp rows and kc columns: each point goes to one row and is copied
    to all columns, each circle to one column and all rows, and every square is a separate join key.
    """
    zero = F.lit(0).cast("bigint")
    board = points.join(hot, ["cx", "cy"]).select(
        "id", "x", "y", F.col("cx").alias("gx"), F.col("cy").alias("gy"),
        F.pmod(F.xxhash64("id"), F.col("kp")).alias("ps"),
        F.explode(F.sequence(zero, F.col("kc") - 1)).alias("cs"),
    )
    targets = hot.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "kp", "kc")
    listed = reach(circles) if reach else neighbour_rows(circles.withColumns({"tx": zero, "ty": zero}), mirrored, clip=False)
    probes = (
        listed.join(targets, ["gx", "gy"])
        .withColumn("cs", F.pmod(F.xxhash64("id"), F.col("kc")))
        .withColumn("ps", F.explode(F.sequence(zero, F.col("kp") - 1)))
    )
    return match(probes, board, ["gx", "gy", "ps", "cs"], radius, mirrored)


def all_pairs(
    left: DataFrame, right: DataFrame, radius: float, layout: DataFrame | None, grid: Grid | None,
    boundary: str, hot_rows: int, rows_per_task: int | None,
) -> DataFrame:
    mirrored = left is right
    side = radius * CELL_SLACK if radius > 0 else 1.0
    points = prepare(right, side)
    circles = points if mirrored else prepare(left, side)
    hot, total = crowded_cells(points, None if mirrored else circles, hot_rows)
    quiet = points if hot is None else points.join(hot, ["cx", "cy"], "left_anti").select(points.columns)
    shift, rows = tile_shift([quiet] if mirrored else [quiet, circles], rows_per_task or PAIR_ROWS // 2)
    if layout is None:
        sent, kept, keys = tile_moves(circles, quiet, mirrored, total, rows, shift)
    else:
        few = rows if rows_per_task else None
        sent, kept, keys = layout_moves(circles, quiet, mirrored, radius, layout, grid, boundary, few, rows, shift)
    # Both sides already sit in the same tasks. The points of a task are bounded
    # by rows_per_task, so their blocks are hashed and those of the circles stream past them.
    here = in_blocks(kept, keys, side).withColumnsRenamed({"cx": "gx", "cy": "gy"}).hint("shuffle_hash")
    listed = neighbour_rows(in_blocks(sent, [*keys, "tx", "ty"], side), mirrored, clip=True, shift=shift)
    pairs = match_blocks(listed, here, [*keys, "gx", "gy"], radius, mirrored)
    if layout is not None and boundary == "closed":
        pairs = pairs.dropDuplicates(["circle_id", "point_id"])
    if hot is not None:
        pairs = pairs.unionByName(crowded_pairs(circles, points, hot, radius, mirrored))
    return pairs


def distance_join(
    left: DataFrame, right: DataFrame, radius: float, layout: DataFrame | None = None,
    grid: Grid | None = None, boundary: str = "half_open", hot_rows: int = HOT_ROWS,
    rows_per_task: int | None = None,
) -> DataFrame:
    """pairs(circle_id, point_id) with dx*dx + dy*dy <= radius*radius.

    ``left`` gives the circle centres and ``right`` the points, both with unique
    ``id``. Passing the same DataFrame twice is the self-join, in which every
    pair is tested once. With a ``layout`` (and its grid) rows meet in the
    layout's partitions; the pairs are the same.
    """
    return all_pairs(left, right, radius, layout, grid, boundary, hot_rows, rows_per_task)


def distance_join_grouped(
    left: DataFrame, right: DataFrame, radius: float, layout: DataFrame | None = None,
    grid: Grid | None = None, boundary: str = "half_open", hot_rows: int = HOT_ROWS,
    rows_per_task: int | None = None, max_ids: int = MAX_IDS, slice_rows: int = JOIN_ROWS,
) -> DataFrame:
    """matches(circle_id, part, point_ids, n): the neighbours of each circle in id order.

    Each row holds ``max_ids`` neighbours, the last part the rest; ``n`` is the number of all
    neighbours of the circle. The rows depend on the pairs alone, not on how they are found.
    Only circles near crowded cells, and ids that several circles have, are grouped from moved pairs.
    """
    side = radius * CELL_SLACK if radius > 0 else 1.0
    points = prepare(right, side)
    circles = points if left is right else prepare(left, side)
    # A circle meets nine cells, and their points must fit the share of a task.
    hot, total = crowded_cells(points, None if left is right else circles, max(1, min(hot_rows, slice_rows // 9)))
    quiet, others = circles, []
    if hot is not None:
        cells = cells_around(hot)
        others.append(circles.join(cells, ["cx", "cy"], "left_semi"))
        quiet = quiet.join(cells, ["cx", "cy"], "left_anti")
    repeated = repeated_ids(circles)
    if repeated is not None:
        # All circles of such an id are grouped together, wherever they lie.
        others = [o.join(repeated, "id", "left_anti") for o in others] + [circles.join(repeated, "id", "left_semi")]
        quiet = quiet.join(repeated, "id", "left_anti")
    lists = neighbour_lists(quiet, points, radius, side, layout, grid, boundary, rows_per_task, total)
    found = list_parts(lists, max_ids)
    if others:
        rest = reduce(DataFrame.unionByName, [o.select("id", "x", "y") for o in others])
        pairs = all_pairs(rest, right, radius, layout, grid, boundary, hot_rows, rows_per_task)
        found = found.unionByName(grouped_pairs(pairs, right, max_ids, slice_rows))
    return found


def cells_around(hot: DataFrame) -> DataFrame:
    """The crowded cells and all cells next to them."""
    near = hot.select(F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    return near.select("cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy")).distinct()


def repeated_ids(circles: DataFrame) -> DataFrame | None:
    """Ids of more than one row, None if there are none."""
    listed = circles.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    rows = collect_small(listed)
    if rows is None:
        return cut_lineage(listed)
    return local_table(circles.sparkSession, rows, "id bigint") if rows else None


def neighbour_lists(
    circles: DataFrame, points: DataFrame, radius: float, side: float, layout: DataFrame | None, grid: Grid | None,
    boundary: str, rows_per_task: int | None, total: int,
) -> DataFrame:
    """lists(circle_id, ids): the points within the radius of each circle, in id order; a list may be empty.

    The moves of a join with the sides changed: each circle goes to one task and each point to every
    task whose circles it may meet. There the points that circles of a cell may meet are one list in id order.
    """
    most = PAIR_ROWS // 2
    shift, rows = tile_shift([points] if circles is points else [points, circles], rows_per_task or most)
    if layout is None:
        sent, kept, keys = tile_moves(points, circles, False, total, rows, shift)
    else:
        few = rows if rows_per_task else None
        sent, kept, keys = layout_moves(points, circles, False, radius, layout, grid, boundary, few, rows, shift)
    cell = [*keys, "tx", "ty", "gx", "gy"]
    met = neighbour_rows(sent, mirrored=False, clip=True, shift=shift).groupBy(*cell)
    candidates = met.agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("candidates"))
    here = in_blocks(kept, [*keys, "tx", "ty"], side).withColumnsRenamed({"cx": "gx", "cy": "gy"})
    most_square = F.lit(radius * radius)

    def square(dx: Column, dy: Column) -> Column:
        return dx * dx + dy * dy

    def reached(p: Column) -> Column:
        gap = square(*(F.greatest(F.col(f"{v}0") - p[v], p[v] - F.col(f"{v}1"), F.lit(0.0)) for v in "xy"))
        return gap <= most_square

    def marked(p: Column) -> Column:
        span = square(*(F.greatest(F.col(f"{v}1") - p[v], p[v] - F.col(f"{v}0")) for v in "xy"))
        return F.struct(p["id"].alias("id"), p["x"].alias("x"), p["y"].alias("y"), (span <= most_square).alias("whole"))

    # A block of circles picks the points that any of them may meet, and marks those that all of them do.
    picked = F.transform(F.filter("candidates", reached), marked)
    blocks = here.join(candidates.hint("shuffle_hash"), cell).select("block", picked.alias("picked"))
    each = blocks.select(F.explode_outer("block").alias("c"), "picked")
    near = F.filter("picked", lambda p: p["whole"] | (square(F.col("c.x") - p["x"], F.col("c.y") - p["y"]) <= most_square))
    lists = each.select(F.col("c.id").alias("circle_id"), near["id"].alias("ids"))
    # A circle on a line that two rectangles share has the same list in both.
    return lists.dropDuplicates(["circle_id"]) if layout is not None and boundary == "closed" else lists


def list_parts(lists: DataFrame, max_ids: int) -> DataFrame:
    """Rows of ``max_ids`` neighbours from whole lists, none for an empty one.

    A list is cut into all its parts before they become rows, so that no row of a part takes the whole list along.
    The outer explode keeps Spark from testing the size of that array by making it, and the list, once more.
    """
    n = F.size("ids")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(max_ids)))

    def part(start: Column) -> Column:
        return F.struct(F.floor(start / max_ids).cast("int").alias("part"), F.slice("ids", start + 1, F.lit(max_ids)).alias("point_ids"))

    cut = lists.select("circle_id", F.transform(starts, part).alias("_parts"), n.cast("bigint").alias("n"))
    parts = cut.select("circle_id", F.explode_outer("_parts").alias("_part"), "n")
    return parts.where("_part IS NOT NULL").select("circle_id", "_part.*", "n")


def grouped_pairs(pairs: DataFrame, points: DataFrame, max_ids: int = MAX_IDS, slice_rows: int = JOIN_ROWS) -> DataFrame:
    """Neighbour lists of pairs(circle_id, point_id) whose points are among ``points``.

    A circle may reach all points. Their ids are cut into slices of at most about ``slice_rows``
    points, so a task ranks the neighbours of a circle in one slice; how many lie in
    the slices before it is carried over from a table with a row per circle and slice.
    """
    slices = 1 << max(0, -(-points.count() // slice_rows) - 1).bit_length()
    if slices == 1:  # no circle has more neighbours than a task may rank
        own = W.partitionBy("circle_id")
        placed = pairs.select(
            "circle_id", "point_id", F.row_number().over(own.orderBy("point_id")).alias("rank"),
            F.lit(0).alias("before"), F.count("*").over(own).alias("n"),
        )
        return in_parts(placed, max_ids)
    ids = points.select(F.col("id").alias("point_id"))
    bounds = ids.agg(F.percentile_approx("point_id", [k / slices for k in range(1, slices)], 16 * slices)).scalar()
    part = above(F.col("_bounds"), slices, F.col("point_id"))
    keys = ["circle_id", "slice"]
    # Both readers below are dealt alike, so Spark makes the pairs once.
    sliced = pairs.withColumn("_bounds", bounds).withColumn("slice", part).select(*keys, "point_id").repartition(*keys)
    sizes = sliced.groupBy(*keys).agg(F.count("*").alias("here"))
    earlier = W.partitionBy("circle_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(
        *keys,
        F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
        F.sum("here").over(W.partitionBy("circle_id")).alias("n"),
    )
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("point_id"))
    return in_parts(sliced.withColumn("rank", rank).join(carry, keys), max_ids)


def in_parts(placed: DataFrame, max_ids: int) -> DataFrame:
    """Rows of ``max_ids`` neighbours from ranked ones."""
    row = F.floor((F.col("before") + F.col("rank") - 1) / max_ids).cast("int")
    return placed.groupBy("circle_id", row.alias("part")).agg(
        F.array_sort(F.collect_list("point_id")).alias("point_ids"), F.max("n").alias("n")
    )
