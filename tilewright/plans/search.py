"""Beam search over layouts: every legal cut of every kept layout is scored in one job.

The points are read once, for a histogram. Point counts and circle copies of
any rectangle then come from its summed-area table, so the search itself costs
the same for any number of points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.rectangles import RECT_DDL
from tilewright.functions.scalar import METRES_PER_DEGREE
from tilewright.operators.grid import Grid, all_cells, cell_counts, number
from tilewright.operators.layout import LAYOUT_KEY, with_coordinates
from tilewright.plans.estimate import estimate_cost
from tilewright.session import cut_lineage, local_table

STATE_DDL = (
    f"parent int, actions array<int>, parts array<{RECT_DDL}>, loads array<array<double>>, cost double"
)


def summed_area(cells: DataFrame, grid: Grid) -> DataFrame:
    """sums(i, j, total): points in rows below i and columns left of j, for each lattice point.

    Sums run along the rows, then along the columns; each window sees one line of cells.
    """
    filled = all_cells(cells.sparkSession, grid).join(cells.select("i", "j", "n"), ["i", "j"], "left")
    n = F.coalesce("n", F.lit(0))
    in_row = filled.withColumn("row_sum", F.sum(n).over(W.partitionBy("i").orderBy("j")))
    inner = in_row.select(
        (F.col("i") + 1).alias("i"),
        (F.col("j") + 1).alias("j"),
        F.sum("row_sum").over(W.partitionBy("j").orderBy("i")).alias("total"),
    )
    lattice = Grid(*grid.box, nx=grid.nx + 1, ny=grid.ny + 1)
    return (
        all_cells(cells.sparkSession, lattice)
        .join(inner, ["i", "j"], "left")
        .select("i", "j", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    )


# One round. ``state`` holds the kept layouts, ``sums`` the summed-area table.
#   cuts      every legal cut of every partition
#   pieces    the two rectangles a cut makes: 0 keeps the id, 1 gets the next one
#   probes    four signed corners per rectangle and reach, met by equality
#   counted   loads of both rectangles: points times circle copies, per query
#   made      the layout after the cut
ROUND = """
WITH cuts AS (
  SELECT parent, pid, part, cut.dir AS dir, cut.i AS i, cut.j AS j,
         (cut.i * {nx} + cut.j) * 2 + cut.dir AS action
  FROM (
    SELECT parent, pid, part, explode(concat(
        transform(IF(part.r1 - part.r0 >= 2, sequence(part.r0 + 1, part.r1 - 1), CAST(array() AS array<int>)),
                  k -> struct(0 AS dir, k AS i, part.c0 AS j)),
        transform(IF(part.c1 - part.c0 >= 2, sequence(part.c0 + 1, part.c1 - 1), CAST(array() AS array<int>)),
                  k -> struct(1 AS dir, part.r0 AS i, k AS j)))) AS cut
    FROM (SELECT parent, posexplode(parts) AS (pid, part) FROM {state})
  )
), pieces AS (
  SELECT parent, pid, action, inline(array(
      struct(0 AS piece, part.c0 AS c0, IF(dir = 1, j, part.c1) AS c1,
             part.r0 AS r0, IF(dir = 0, i, part.r1) AS r1),
      struct(1 AS piece, IF(dir = 1, j, part.c0) AS c0, part.c1 AS c1,
             IF(dir = 0, i, part.r0) AS r0, part.r1 AS r1)))
  FROM cuts
), probes AS (
  SELECT parent, pid, action, piece, inline(array({corners})) FROM pieces
), counted AS (
  SELECT parent, pid, action,
         array({low_loads}) AS load_low, array({high_loads}) AS load_high
  FROM probes JOIN {sums} USING (i, j)
  GROUP BY parent, pid, action
), opened AS (
  SELECT *, parts[pid] AS part, action % 2 = 1 AS upright,
         action div (2 * {nx}) AS i, action div 2 % {nx} AS j
  FROM counted JOIN {state} USING (parent)
), shaped AS (
  SELECT *,
    struct(part.c0 AS c0, CAST(IF(upright, j, part.c1) AS INT) AS c1,
           part.r0 AS r0, CAST(IF(upright, part.r1, i) AS INT) AS r1) AS low,
    struct(CAST(IF(upright, j, part.c0) AS INT) AS c0, part.c1 AS c1,
           CAST(IF(upright, part.r0, i) AS INT) AS r0, part.r1 AS r1) AS high
  FROM opened
), made AS (
  SELECT parent, action,
         concat(actions, array(action)) AS actions,
         concat(transform(parts, (p, k) -> IF(k = pid, low, p)), array(high)) AS parts,
         concat(transform(loads, (l, k) -> IF(k = pid, load_low, l)), array(load_high)) AS loads
  FROM shaped
), scored AS (
  SELECT *, {rank} AS cost FROM made
), marked AS (
  {marked}
), distinct_layouts AS (
  SELECT min_by(struct(actions, parts, loads, cost, explore), actions) AS one
  FROM marked GROUP BY array_sort(parts)
)
SELECT one.actions, one.parts, one.loads, one.cost FROM distinct_layouts
ORDER BY one.explore DESC, one.cost, one.actions LIMIT {beam}
"""

# Which candidates are kept for exploration. A parent explores with the given
# probabilities: then one random cut of it, or its best cut moved by some lines,
# is kept whatever it costs. Draws depend on the seed and the parent's cuts only.
EXPLORE = """
  SELECT *, (u < {eps_random} AND action = random_action)
         OR (u >= 1 - {eps_shift} AND action = best_action + 2 * shift * IF(best_action % 2 = 0, {nx}, 1))
         AS explore
  FROM (
    SELECT *,
      pmod(xxhash64({seed}, 0, parent_path), 1048576) / 1048576D AS u,
      get(array({shifts}), CAST(pmod(xxhash64({seed}, 1, parent_path), {n_shifts}) AS INT)) AS shift,
      min(struct(xxhash64({seed}, parent_path, action) AS h, action)) OVER w .action AS random_action,
      min(struct(cost, action)) OVER w .action AS best_action
    FROM (SELECT *, array_join(slice(actions, 1, size(actions) - 1), ',') AS parent_path FROM scored)
    WINDOW w AS (PARTITION BY parent)
  )
"""


class Loads:
    """How loads of rectangles are read from the histogram of a finer grid."""

    def __init__(self, points: DataFrame, grid: Grid, workload: DataFrame, histogram_cells: int):
        # Circle copies are counted in whole histogram cells, so finer cells
        # overstate small radii less.
        self.factor = max(1, math.isqrt(histogram_cells // grid.cells))
        self.fine = Grid(*grid.box, nx=grid.nx * self.factor, ny=grid.ny * self.factor)
        queries = workload.select("qid", "distance", "rate").orderBy("qid").collect()
        self.rates = [float(q.rate) for q in queries]
        # Cells a circle may reach past a rectangle, along x and y: none for the
        # points themselves, then one pair per query.
        steps = self.fine.axis("x")[3], self.fine.axis("y")[3]
        self.reach = [(0, 0)] + [
            tuple(math.ceil(q.distance / METRES_PER_DEGREE / s) if s else 0 for s in steps)
            for q in queries
        ]
        # Every round reads the sums, so they are written once.
        self.sums = cut_lineage(summed_area(cell_counts(points, self.fine), self.fine))

    def corners(self) -> str:
        """The four signed corners of a rectangle for each reach."""
        f, nx, ny = self.factor, self.fine.nx, self.fine.ny
        listed = []
        for slot, (gx, gy) in enumerate(self.reach):
            i0, i1 = f"greatest(r0 * {f} - {gy}, 0)", f"least(r1 * {f} + {gy}, {ny})"
            j0, j1 = f"greatest(c0 * {f} - {gx}, 0)", f"least(c1 * {f} + {gx}, {nx})"
            for sign, i, j in ((1, i1, j1), (-1, i0, j1), (-1, i1, j0), (1, i0, j0)):
                listed.append(f"struct({slot} AS slot, {sign} AS sign, {i} AS i, {j} AS j)")
        return ", ".join(listed)

    def of_piece(self, piece: int) -> str:
        """Points times circle copies of one piece, for each query."""
        counts = [
            f"CAST(sum(IF(piece = {piece} AND slot = {slot}, sign * total, 0)) AS DOUBLE)"
            for slot in range(len(self.reach))
        ]
        return ", ".join(f"{counts[0]} * {m}" for m in counts[1:])

    def cost(self, how: str) -> str:
        """Rate-weighted cost of a finished layout."""
        terms = []
        for q, rate in enumerate(self.rates):
            values = f"transform(loads, l -> l[{q}])"
            if how == "max":
                value = f"array_max({values})"
            else:
                value = f"aggregate({values}, 0D, (a, v) -> a + v)"
            terms.append(f"{value} * {number(rate)}")
        return " + ".join(terms)

    def completion_bound(self, max_partitions: int) -> str:
        """Largest load left if the remaining cuts go where they help most and split evenly.

        A partition in k even pieces has 1/k^2 of its load in each. The bound is
        the smallest value for which all pieces number at most ``max_partitions``.
        """
        rates = ", ".join(number(r) for r in self.rates)
        weighted = (
            f"transform(loads, l -> aggregate(zip_with(l, array({rates}), (v, r) -> v * r), 0D, (a, v) -> a + v))"
        )
        values = f"flatten(transform({weighted}, v -> transform(sequence(1, {max_partitions}), k -> v / (k * k))))"
        needed = f"aggregate({weighted}, 0D, (a, v) -> a + greatest(ceil(sqrt(v / t) - 1e-9), 1))"
        return f"coalesce(array_min(filter({values}, t -> t > 0 AND {needed} <= {max_partitions})), 0D)"


def search_layouts(
    points: DataFrame, grid: Grid, workload: DataFrame, max_partitions: int = 8, beam: int = 8,
    eps_random: float = 0.1, eps_shift: float = 0.2, shift_grids: int = 1, how: str = "max", seed: int = 0,
    histogram_cells: int = 50_000,
) -> DataFrame:
    """The ``beam`` layouts found, by ascending cost as layout_id 0, 1, ...

    ``cost`` is the exact estimate of ``estimate_cost``. The search itself reads loads from a
    histogram of about ``histogram_cells`` cells, the grid's own if it has more: it counts
    circle copies in whole cells, so more cells rank small radii better.

    Layouts grow from the root by one cut per round, and every legal cut of every
    kept layout is scored. Until the last cut, layouts are ranked by what they
    can still become, since the largest load says little before that.
    Different cut orders that give the same rectangles count once. What goes
    from round to round is the kept layouts only.
    """
    spark = points.sparkSession
    loads = Loads(points, grid, workload, histogram_cells)
    shifts = [s for s in range(-shift_grids, shift_grids + 1) if s != 0]
    explore = EXPLORE
    for name, value in {
        "eps_random": number(eps_random), "eps_shift": number(eps_shift), "nx": grid.nx, "seed": seed,
        "shifts": ", ".join(map(str, shifts)), "n_shifts": len(shifts),
    }.items():
        explore = explore.replace("{" + name + "}", str(value))
    plain = "SELECT *, false AS explore FROM scored"

    root = dict(zip(("c0", "c1", "r0", "r1"), (0, grid.nx, 0, grid.ny)))
    kept = [([], [root], [[0.0] * len(loads.rates)], None)]
    last = max_partitions - 1
    for turn in range(1, last + 1):
        final = turn == last
        open_rank = loads.completion_bound(max_partitions) if how == "max" else loads.cost(how)
        query = ROUND
        for name, value in {
            "nx": grid.nx, "corners": loads.corners(), "beam": beam,
            "low_loads": loads.of_piece(0), "high_loads": loads.of_piece(1),
            "rank": loads.cost(how) if final else open_rank,
            "marked": plain if final or not shifts or eps_random + eps_shift <= 0 else explore,
        }.items():
            query = query.replace("{" + name + "}", str(value))
        state = local_table(spark, [(k, *row) for k, row in enumerate(kept)], STATE_DDL)
        found = spark.sql(query, state=state, sums=loads.sums).collect()
        kept = [tuple(r.asDict(recursive=True).values()) for r in found]
    ddl = f"{LAYOUT_KEY} int, pid int, c0 int, c1 int, r0 int, r1 int, cost double"

    def layouts(rows: list[tuple], costs: list[float | None]) -> DataFrame:
        rects = [
            (k, pid, p["c0"], p["c1"], p["r0"], p["r1"], cost)
            for k, (row, cost) in enumerate(zip(rows, costs))
            for pid, p in enumerate(row[1])
        ]
        return with_coordinates(local_table(spark, rects, ddl), grid)

    found = layouts(kept, [None] * len(kept)).drop("cost")
    exact = {r[LAYOUT_KEY]: float(r.cost) for r in estimate_cost(points, found, workload, grid, how).collect()}
    order = sorted(range(len(kept)), key=lambda k: (exact[k], kept[k][0]))
    return layouts([kept[k] for k in order], [exact[k] for k in order])
