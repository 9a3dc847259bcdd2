"""Where rows live under a layout: assignment, statistics, circle copies, physical placement."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import metres_to_degrees
from tilewright.operators.cut_tree import CutTree, cut_tree
from tilewright.operators.grid import Grid, assign_cells, cell_span, inside_grid
from tilewright.operators.layout import LAYOUT_KEY, RECT_COLUMNS
from tilewright.session import SMALL_ROWS, collect_small, literal_array, shuffle_slots

# Points a task of a join or of a placed table should hold: at least, unless a
# partition has fewer, and at most.
TASK_ROWS = 50_000
JOIN_ROWS = 2_000_000

# Points whose pairs one task makes: their ids fit the dictionary of a written column.
PAIR_ROWS = 50_000

# Numbers the lookup of all layouts of a table may hold in the plan. A layout of n
# rectangles needs at most 4 n * n, whatever the number of points or cells.
LOOKUP_ENTRIES = 2_000_000

# A layout whose table of bands and strips would hold more numbers is looked up in the tree of its cuts.
TABLE_ENTRIES = 100_000


@dataclass
class Owners:
    """One layout as the driver knows it.

    The edges of its rectangles cut the grid into bands of rows and strips of columns.
    ``band`` and ``strip`` say where a grid row or column lies, ``cells`` who owns each
    band and strip, in row-major order; -1 is nobody. So the table follows the number of
    rectangles, however fine the grid. Of layouts with very many of them, ``tree`` is known instead.
    """

    layout_id: int
    band: list[int]
    strip: list[int]
    cells: list[int]
    top: int  # the greatest pid
    tree: CutTree | None = None

    @property
    def entries(self) -> int:
        return 9 * len(self.tree.boxes) if self.tree else len(self.cells) + len(self.band) + len(self.strip)


# What has been read of a layout DataFrame, for as long as that DataFrame lives.
KNOWN: WeakKeyDictionary[DataFrame, tuple[Grid, list[Owners]]] = WeakKeyDictionary()


def owner_lookup(layout: DataFrame, grid: Grid) -> list[Owners]:
    """Owners of every layout in the table. Layouts are small by nature; a table that is not is refused."""
    if layout not in KNOWN or KNOWN[layout][0] != grid:
        KNOWN[layout] = grid, read_owners(layout, grid)
    return KNOWN[layout][1]


def read_owners(layout: DataFrame, grid: Grid) -> list[Owners]:
    rows = collect_small(layout.select(LAYOUT_KEY, "pid", *RECT_COLUMNS))
    if rows is None:
        raise ValueError(f"more than {SMALL_ROWS} layout rows; place them in several tables")
    by_layout: dict[int, list] = {}
    for r in rows:
        by_layout.setdefault(r[LAYOUT_KEY], []).append(r)
    found = [owners_of(key, parts, grid) for key, parts in sorted(by_layout.items())]
    if sum(o.entries for o in found) > LOOKUP_ENTRIES:
        raise ValueError(f"the layouts need more than {LOOKUP_ENTRIES} lookup entries")
    return found


def owners_of(layout_id: int, rects: list, grid: Grid) -> Owners:
    def pieces(n: int, low: str, high: str) -> tuple[list[int], list[int]]:
        edges = sorted({0, n} | {r[c] for r in rects for c in (low, high)})
        return edges, [bisect_right(edges, k) - 1 for k in range(n)]

    rows, band = pieces(grid.ny, "r0", "r1")
    columns, strip = pieces(grid.nx, "c0", "c1")
    width, top = len(columns) - 1, max(r.pid for r in rects)
    if width * (len(rows) - 1) > TABLE_ENTRIES:
        tree = cut_tree([(r.pid, r.c0, r.c1, r.r0, r.r1) for r in rects])
        if tree is not None:
            return Owners(layout_id, [], [], [], top, tree)
        if width * (len(rows) - 1) > LOOKUP_ENTRIES:
            raise ValueError(f"no line cuts the layout apart, and it needs more than {LOOKUP_ENTRIES} lookup entries")
    cells = [-1] * (width * (len(rows) - 1))
    for r in rects:
        first, stop = columns.index(r.c0), columns.index(r.c1)
        for k in range(rows.index(r.r0), rows.index(r.r1)):
            cells[k * width + first : k * width + stop] = [r.pid] * (stop - first)
    return Owners(layout_id, band, strip, cells, top)


def at(table: list[int], k: Column) -> Column:
    return F.get(literal_array(table, "int"), k.cast("int"))


def owner_at(owners: Owners, i: Column, j: Column) -> Column:
    """Owner of a cell, -1 for a null cell and one that nobody owns.

    Never null, so joins on it push no null test down over the lookup.
    """
    if owners.tree:
        return owners.tree.owner(i, j)
    width = max(owners.strip) + 1
    return F.coalesce(at(owners.cells, at(owners.band, i) * width + at(owners.strip, j)), F.lit(-1))


def owners_in_span(owners: Owners, i0: Column, i1: Column, j0: Column, j1: Column) -> Column:
    """Distinct owners of the cells in a block of rows i0..i1 and columns j0..j1; [-1] if there are none.

    Nearly every block is one cell, which is answered without building arrays.
    """
    nobody = F.array(F.lit(-1))
    if owners.tree:
        some = owners.tree.owners(i0, i1, j0, j1)
        return F.when(F.size(some) > 0, some).otherwise(nobody)
    width = max(owners.strip) + 1
    table = literal_array(owners.cells, "int")
    many = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(at(owners.band, i0), at(owners.band, i1)),
                lambda i: F.transform(
                    F.sequence(at(owners.strip, j0), at(owners.strip, j1)),
                    lambda j: F.get(table, (i * width + j).cast("int")),
                ),
            )
        )
    )
    some = F.array_remove(many, -1)
    one = F.array(owner_at(owners, i0, j0))
    single = (i0.isNull() | j0.isNull()) | ((i0 == i1) & (j0 == j1))
    return F.when(single, one).otherwise(F.when(F.size(some) > 0, some).otherwise(nobody))


def spans(grid: Grid, radius: str, boundary: str) -> tuple[Column, Column, Column, Column]:
    """Cell block (i0, i1, j0, j1) met by the square of half-width ``radius`` around (x, y)."""
    i0, i1 = cell_span(f"y - {radius}", f"y + {radius}", grid, "y", boundary)
    j0, j1 = cell_span(f"x - {radius}", f"x + {radius}", grid, "x", boundary)
    return i0, i1, j0, j1


def placed_in(df: DataFrame, layout: DataFrame, grid: Grid, pids: Callable[[Owners], Column]) -> DataFrame:
    """One row per input row, layout and pid, by a projection: no shuffle, no join."""
    owners = owner_lookup(layout, grid)
    if not owners:
        return df.select(F.lit(None).cast("int").alias(LAYOUT_KEY), "*", F.lit(-1).alias("pid")).limit(0)
    if len(owners) == 1:
        return df.select(F.lit(owners[0].layout_id).alias(LAYOUT_KEY), "*", F.explode(pids(owners[0])).alias("pid"))
    each = [F.struct(F.lit(o.layout_id).alias(LAYOUT_KEY), pids(o).alias("pids")) for o in owners]
    spread = df.select("*", F.explode(F.array(*each)).alias("_of"))
    return spread.select(f"_of.{LAYOUT_KEY}", *df.columns, F.explode("_of.pids").alias("pid"))


def explode_owners(df: DataFrame, layout: DataFrame, grid: Grid) -> DataFrame:
    """One row per distinct owner, in each layout, of the block (i0, i1, j0, j1) of each input row."""
    block = [F.col(c) for c in ("i0", "i1", "j0", "j1")]
    placed = placed_in(df, layout, grid, lambda o: owners_in_span(o, *block))
    return placed.drop("i0", "i1", "j0", "j1")


def only_layout(layout: DataFrame, grid: Grid) -> int:
    """Id of the one layout in the table; physical placement and joins take one at a time."""
    ids = [o.layout_id for o in owner_lookup(layout, grid)]
    if len(ids) != 1:
        raise ValueError(f"one layout is wanted here, the table has {len(ids)}")
    return ids[0]


def assign_partitions(
    points: DataFrame, layout: DataFrame, grid: Grid, boundary: str = "half_open", outside: str = "clamp"
) -> DataFrame:
    """Add ``layout_id`` and ``pid`` to each point.

    ``half_open`` gives every point exactly one partition per layout. ``closed``
    repeats a point that lies on a shared line. Points outside the grid go to
    the nearest edge cell, or are left out with ``outside="drop"``. A point with a null
    coordinate, and one in a cell that no rectangle covers, has the pid -1.
    """
    if outside == "drop":
        points = points.filter(inside_grid(grid))
    if boundary == "closed":
        i0, i1, j0, j1 = spans(grid, "0", boundary)
        return explode_owners(points.withColumns({"i0": i0, "i1": i1, "j0": j0, "j1": j1}), layout, grid)
    own = points.columns
    cells = assign_cells(points, grid)
    owners = owner_lookup(layout, grid)
    if len(owners) == 1:
        pid = owner_at(owners[0], F.col("i"), F.col("j"))
        return cells.withColumns({LAYOUT_KEY: F.lit(owners[0].layout_id), "pid": pid}).select(*own, LAYOUT_KEY, "pid")
    placed = placed_in(cells, layout, grid, lambda o: F.array(owner_at(o, F.col("i"), F.col("j"))))
    return placed.select(*own, LAYOUT_KEY, "pid")


def buffer_points(points: DataFrame, radius: float | Column) -> DataFrame:
    """circles: point columns, radius and the bounding square bx0..bx1, by0..by1."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return points.withColumns(
        {
            "radius": r,
            "bx0": F.col("x") - r,
            "bx1": F.col("x") + r,
            "by0": F.col("y") - r,
            "by1": F.col("y") + r,
        }
    )


def replicate_circles(circles: DataFrame, layout: DataFrame, grid: Grid, boundary: str = "half_open") -> DataFrame:
    """One row per circle and partition whose rectangle its bounding square meets."""
    i0, i1 = cell_span("by0", "by1", grid, "y", boundary)
    j0, j1 = cell_span("bx0", "bx1", grid, "x", boundary)
    block = circles.withColumns({"i0": i0, "i1": i1, "j0": j0, "j1": j1})
    return explode_owners(block, layout, grid)


def block_counts(points: DataFrame, grid: Grid, workload: DataFrame | None = None, boundary: str = "half_open") -> DataFrame:
    """How many circles share each block of grid cells, per query of the workload.

    This is the only pass over the points that partition statistics need: the
    block table depends on the grid and radius, not on the number of points, and
    serves any number of layouts. Without a workload the circles have radius 0.
    """
    if workload is None:
        keyed, radius = points.withColumn("qid", F.lit(0)), "0"
    else:
        queries = F.array(
            *[
                F.struct(F.lit(int(w.qid)).alias("qid"), F.lit(float(w.distance)).alias("distance"))
                for w in workload.select("qid", "distance").collect()
            ]
        )
        keyed = points.select("x", "y", F.explode(queries).alias("q")).select(
            "x", "y", "q.qid", metres_to_degrees(F.col("q.distance")).alias("radius")
        )
        radius = "radius"
    i0, i1, j0, j1 = spans(grid, radius, boundary)
    return keyed.groupBy(
        "qid", i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1")
    ).agg(F.count("*").alias("n"))


def owner_counts(blocks: DataFrame, layouts: DataFrame, grid: Grid, name: str) -> DataFrame:
    """Rows per (layout_id, qid, pid) from block counts."""
    placed = explode_owners(blocks, layouts, grid)
    return placed.groupBy(LAYOUT_KEY, "qid", "pid").agg(F.sum("n").alias(name))


def partition_stats(points: DataFrame, layout: DataFrame, grid: Grid, boundary: str = "half_open") -> DataFrame:
    """Layout rows with ``n`` points and ``share`` of all points, empty partitions included."""
    blocks = block_counts(points.filter(inside_grid(grid)), grid, boundary=boundary)
    counts = owner_counts(blocks, layout, grid, "n_points").drop("qid")
    total = points.agg(F.count("*").cast("double")).scalar()
    n = F.coalesce(F.col("n_points"), F.lit(0)).cast("bigint")
    base = layout.drop("n", "share")
    return (
        base.join(counts, [LAYOUT_KEY, "pid"], "left")
        .withColumns({"n": n, "share": F.coalesce(F.try_divide(n.cast("double"), total), F.lit(0.0))})
        .drop("n_points")
    )


def circle_stats(points: DataFrame, layouts: DataFrame, workload: DataFrame, grid: Grid, boundary: str = "half_open") -> DataFrame:
    """Circle copies ``m`` per (layout_id, qid, pid) for the radii of a workload."""
    return owner_counts(block_counts(points, grid, workload, boundary), layouts, grid, "m")


def fullest_partition(stats: DataFrame) -> DataFrame:
    """The partition with most points in each layout; the lowest pid wins a tie."""
    best = F.max_by(F.struct("pid", "n"), F.struct(F.col("n"), -F.col("pid")))
    return stats.groupBy(LAYOUT_KEY).agg(best.alias("top")).select(LAYOUT_KEY, "top.*")


def fair_share(total: int, tasks: int, most: int) -> int:
    """Rows one task should get: an even share, but neither tiny nor more than ``most``."""
    return max(min(total // tasks, most), min(TASK_ROWS, most))


def placement(
    points: DataFrame, layout: DataFrame, grid: Grid, rows_per_task: int | None = None, most: int = JOIN_ROWS
) -> tuple[list[int], list[int], int]:
    """First slot and number of slots of each pid, and the total number of slots.

    A partition within ``rows_per_task`` points is one slot. A fuller one is
    spread over as many slots as it needs, so no task holds more than its share.
    By default a share is the points divided by the session's shuffle partitions, at ``most`` that many.
    """
    only_layout(layout, grid)
    stats = layout if "n" in layout.columns else partition_stats(points, layout, grid)
    counts = {r.pid: r.n for r in stats.select("pid", "n").collect()}
    share = rows_per_task or fair_share(
        sum(counts.values()), shuffle_slots(points.sparkSession), most
    )
    slots = [max(1, -(-counts.get(p, 0) // share)) for p in range(max(counts) + 1)]
    first = [0, *accumulate(slots)][:-1]
    return first, slots, sum(slots)


def partition_by_layout(points: DataFrame, layout: DataFrame, grid: Grid, rows_per_task: int | None = None) -> DataFrame:
    """Move the table so that each Spark partition holds points of one rectangle only."""
    first, slots, total = placement(points, layout, grid, rows_per_task)
    placed = assign_partitions(points, layout, grid)
    return placed.repartitionById(total, slot_of(F.xxhash64("id"), first, slots))


def slot_of(spread: Column, first: list[int], slots: list[int]) -> Column:
    """Slot of a row of partition ``pid``; ``spread`` picks one when the partition has several."""
    way = F.pmod(spread, F.get(literal_array(slots, "bigint"), F.col("pid")))
    slot = F.get(literal_array(first, "bigint"), F.col("pid")) + way
    return F.coalesce(slot, F.lit(0)).cast("int")
