"""What each query must return, as SQL over the same tables.

The statements are written from the meaning of the operators: theta joins,
range joins and plain windows, none of the methods the library uses.
"""

from __future__ import annotations

from checks.queries import ABORT_PRICE, DISTANCES, EVEN_CUTS, FINE, FINE_CUTS, MIXED_CUTS, RADII, RADIUS, RATES

N = 30

POINTS = """
pts AS (
  SELECT event_id AS id,
         date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 8.64e10 AS x,
         value / 10 AS y
  FROM events
), bb AS (
  SELECT floor(min(x) * 100000::DOUBLE) / 100000 AS min_x, ceil(max(x) * 100000::DOUBLE) / 100000 AS max_x,
         floor(min(y) * 100000::DOUBLE) / 100000 AS min_y, ceil(max(y) * 100000::DOUBLE) / 100000 AS max_y
  FROM pts
)"""

# Lines as a table, and each point's cell found by comparing it with the lines.
GRID = f"""{POINTS}, lines AS MATERIALIZED (
  SELECT 'x' AS axis, k::INT AS idx, CASE WHEN k = {N} THEN max_x ELSE k * ((max_x - min_x) / {N}) + min_x END AS v
  FROM bb, range({N} + 1) t(k)
  UNION ALL
  SELECT 'y', k::INT, CASE WHEN k = {N} THEN max_y ELSE k * ((max_y - min_y) / {N}) + min_y END
  FROM bb, range({N} + 1) t(k)
), strips AS MATERIALIZED (
  SELECT a.axis, a.idx, a.v AS lo, b.v AS hi, a.idx = {N} - 1 AS outer_strip
  FROM lines a JOIN lines b ON a.axis = b.axis AND b.idx = a.idx + 1
), cells AS MATERIALIZED (
  SELECT p.id, p.x, p.y, sy.idx AS i, sx.idx AS j
  FROM pts p
  JOIN strips sx ON sx.axis = 'x' AND p.x >= sx.lo AND (p.x < sx.hi OR (sx.outer_strip AND p.x <= sx.hi))
  JOIN strips sy ON sy.axis = 'y' AND p.y >= sy.lo AND (p.y < sy.hi OR (sy.outer_strip AND p.y <= sy.hi))
)"""


def apply_by_hand(actions: list[int], n: int = N) -> list[list[int]]:
    """Rectangles (c0, c1, r0, r1) a cut sequence leads to."""
    rects = [[0, n, 0, n]]
    for action in actions:
        i, j, vertical = action // (2 * n), action // 2 % n, action % 2
        c0, c1, r0, r1 = owner = next(
            r for r in rects if r[0] <= j < r[1] and r[2] <= i < r[3]
        )
        owner[1 if vertical else 3] = j if vertical else i
        rects.append([j, c1, r0, r1] if vertical else [c0, c1, i, r1])
    return rects


def layout_values(actions: list[int], name: str = "lay", n: int = N) -> str:
    rows = ", ".join(
        f"({pid}, {', '.join(map(str, r))})" for pid, r in enumerate(apply_by_hand(actions, n))
    )
    return f"{name}(pid, c0, c1, r0, r1) AS (VALUES {rows})"


EVEN = f"{GRID}, {layout_values(EVEN_CUTS)}"

IN_PART = "c.j >= l.c0 AND c.j < l.c1 AND c.i >= l.r0 AND c.i < l.r1"

STATS = f"""{EVEN}, stats AS (
  SELECT l.pid, l.c0, l.c1, l.r0, l.r1, count(c.id) AS n
  FROM lay l LEFT JOIN cells c ON {IN_PART} GROUP BY ALL
)"""

# Partition rectangles in coordinates.
BOXES = """boxes AS (
  SELECT l.*, a.v AS min_x, b.v AS max_x, c.v AS min_y, d.v AS max_y
  FROM lay l JOIN lines a ON a.axis = 'x' AND a.idx = l.c0 JOIN lines b ON b.axis = 'x' AND b.idx = l.c1
  JOIN lines c ON c.axis = 'y' AND c.idx = l.r0 JOIN lines d ON d.axis = 'y' AND d.idx = l.r1
)"""


def overlap(radius: str, n: int = N) -> str:
    """Does the square around (x, y) meet the box? Outermost boxes have no far edge."""
    return (
        f"(x - {radius} < max_x OR c1 = {n}) AND (x + {radius} >= min_x OR c0 = 0) AND "
        f"(y - {radius} < max_y OR r1 = {n}) AND (y + {radius} >= min_y OR r0 = 0)"
    )


def fine_line(axis: str, k: str) -> str:
    low, high = f"min_{axis}", f"max_{axis}"
    return f"CASE WHEN {k} = {FINE} THEN b.{high} ELSE {k} * ((b.{high} - b.{low}) / {FINE}) + b.{low} END"


# Points on a coarse raster and a layout of a fine grid, its rectangles in coordinates.
FINE_BOXES = f"""{POINTS.replace("/ 8.64e10 AS x", "/ 8.64e10 * 10)::DOUBLE / 10 AS x").replace("date_diff(", "floor(date_diff(").replace("value / 10 AS y", "floor(value / 10 * 10)::DOUBLE / 10 AS y")},
{layout_values(FINE_CUTS, n=FINE)}, boxes AS (
  SELECT l.*, {fine_line("x", "l.c0")} AS min_x, {fine_line("x", "l.c1")} AS max_x,
         {fine_line("y", "l.r0")} AS min_y, {fine_line("y", "l.r1")} AS max_y
  FROM lay l, bb b
)"""

FINE_CLOSED = "x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y"


CUTS_OF = f"""
  SELECT l.pid, 0 AS dir, k::INT AS i, l.c0 AS j FROM {{layout}} l, range({N} + 1) t(k) WHERE k > l.r0 AND k < l.r1
  UNION ALL
  SELECT l.pid, 1, l.r0, k::INT FROM {{layout}} l, range({N} + 1) t(k) WHERE k > l.c0 AND k < l.c1
"""

ROOT_CUTS = f"""{GRID}, root(pid, c0, c1, r0, r1) AS (VALUES (0, 0, {N}, 0, {N})),
root_cuts AS ({CUTS_OF.format(layout='root')}), counted AS (
  SELECT r.pid, r.dir, r.i, r.j, (2 * (r.i * {N} + r.j) + r.dir)::INT AS action,
         count(c.id) AS n_low
  FROM root_cuts r LEFT JOIN cells c ON CASE WHEN r.dir = 0 THEN c.i < r.i ELSE c.j < r.j END
  GROUP BY ALL
)"""


def greedy_rounds(layout: str, rounds: int) -> str:
    """Common tables that cut the fullest partition of ``layout`` again and again: lay_1, lay_2, ..."""
    parts, current = [], layout
    for k in range(1, rounds + 1):
        parts.append(f"""full_{k} AS MATERIALIZED (
  SELECT l.pid, l.c0, l.c1, l.r0, l.r1, count(c.id) AS n, median(c.x) AS mx, median(c.y) AS my
  FROM {current} l LEFT JOIN cells c ON {IN_PART} GROUP BY ALL ORDER BY n DESC, pid LIMIT 1
), tall_{k} AS MATERIALIZED (
  SELECT f.*, (d.v - c.v) > (b.v - a.v) AS tall
  FROM full_{k} f JOIN lines a ON a.axis = 'x' AND a.idx = f.c0 JOIN lines b ON b.axis = 'x' AND b.idx = f.c1
  JOIN lines c ON c.axis = 'y' AND c.idx = f.r0 JOIN lines d ON d.axis = 'y' AND d.idx = f.r1
), cut_{k} AS MATERIALIZED (
  SELECT t.*, l.idx AS line
  FROM tall_{k} t JOIN lines l ON CASE WHEN t.tall THEN l.axis = 'y' AND l.idx > t.r0 AND l.idx < t.r1
                                       ELSE l.axis = 'x' AND l.idx > t.c0 AND l.idx < t.c1 END
  ORDER BY abs(l.v - CASE WHEN t.tall THEN t.my ELSE t.mx END), l.idx LIMIT 1
), lay_{k} AS MATERIALIZED (
  SELECT l.pid, l.c0, CASE WHEN l.pid = c.pid AND NOT c.tall THEN c.line ELSE l.c1 END AS c1,
         l.r0, CASE WHEN l.pid = c.pid AND c.tall THEN c.line ELSE l.r1 END AS r1
  FROM {current} l, cut_{k} c
  UNION ALL
  SELECT (SELECT max(pid) + 1 FROM {current}), CASE WHEN tall THEN c0 ELSE line END, c1,
         CASE WHEN tall THEN line ELSE r0 END, r1
  FROM cut_{k}
)""")
        current = f"lay_{k}"
    return ", ".join(parts)


GREEDY = f"""{GRID}, root(pid, c0, c1, r0, r1) AS (VALUES (0, 0, {N}, 0, {N})), {greedy_rounds('root', 7)}"""

CHOSEN = f"""{EVEN}, {greedy_rounds('lay', 1)}, chosen AS (
  SELECT pid, (CASE WHEN tall THEN 2 * (line * {N} + c0) ELSE 2 * (r0 * {N} + line) + 1 END)::INT AS action
  FROM cut_1
)"""

WORKLOAD = "workload(qid, distance, rate) AS (VALUES " + ", ".join(
    f"({q}, {d}::DOUBLE, {r}::DOUBLE)" for q, (d, r) in enumerate(zip(DISTANCES, RATES))
) + ")"

LOADS = f"""{EVEN}, {BOXES}, {WORKLOAD}, loads AS (
  SELECT w.qid, b.pid,
    (SELECT count(*) FROM cells c WHERE c.j >= b.c0 AND c.j < b.c1 AND c.i >= b.r0 AND c.i < b.r1) AS n,
    count(p.id) AS m
  FROM boxes b CROSS JOIN workload w LEFT JOIN pts p ON {overlap('w.distance / 110000')}
  GROUP BY w.qid, b.pid, b.c0, b.c1, b.r0, b.r1
)"""


def pairs(radius: str) -> str:
    return f"""{POINTS}, pairs AS (
  SELECT a.id AS circle_id, b.id AS point_id FROM pts a, pts b
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {radius} * {radius}
)"""


NEAR = f"WITH {pairs(f'{RADIUS}::DOUBLE')} "

TRIALS = f"""
trials AS (
  SELECT (o_orderkey // 9)::INT AS layout_id, ((o_orderkey % 9) // 3)::INT AS qid,
         (o_orderkey % 3)::INT AS trial, o_totalprice / 1000 AS seconds,
         o_totalprice > {ABORT_PRICE} AS aborted
  FROM orders
), costs AS (
  SELECT layout_id, qid, CASE WHEN NOT bool_or(aborted) THEN median(seconds) END AS seconds FROM trials GROUP BY ALL
), {WORKLOAD}, evals AS (
  SELECT layout_id, layout_id AS seq,
         CASE WHEN count(seconds) = 3 THEN sum(seconds * rate) END AS cost,
         CASE WHEN count(seconds) = 3 THEN 'ok' ELSE 'aborted' END AS status
  FROM costs JOIN workload USING (qid) GROUP BY ALL
), marked AS (
  SELECT *, coalesce(cost < best_before, false) AS improved,
         cost IS NOT NULL AND (best_before IS NULL OR cost < best_before) AS leads
  FROM (SELECT *, min(cost) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
        FROM evals)
)"""



def grouped(max_ids: int) -> str:
    """Neighbour lists in parts of so many ids, with the number of all neighbours of the circle."""
    return NEAR + f""", placed AS (
  SELECT *, row_number() OVER (PARTITION BY circle_id ORDER BY point_id) - 1 AS place, count(*) OVER (PARTITION BY circle_id) AS n
  FROM pairs
) SELECT circle_id, (place // {max_ids})::INT AS part, string_agg(point_id::VARCHAR, ',' ORDER BY point_id) AS point_ids,
         any_value(n) AS n FROM placed GROUP BY circle_id, part"""


STEPS = """
steps AS (
  SELECT user_id AS episode, row_number() OVER w - 1 AS step, value / 100 AS reward,
         lead(ts) OVER w IS NULL AS done
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), totals AS (
  SELECT episode, sum(reward) AS reward FROM steps GROUP BY episode
)"""

MEMORY = """
memory AS (
  SELECT event_id AS idx, pow(abs(value / 100) + 0.0001::DOUBLE, 0.6::DOUBLE) AS priority FROM events
), cum AS (
  SELECT *, sum(priority) OVER (ORDER BY idx) AS upto FROM memory
), draws AS (
  SELECT k AS draw, (SELECT sum(priority) FROM memory) * (k + 0.5::DOUBLE) / 32 AS s FROM range(32) t(k)
), hits AS (
  SELECT draw, min(idx) AS idx FROM draws JOIN cum ON upto >= s GROUP BY draw
)"""



def toss(seed: int, *keys: str) -> str:
    """Whole number fixed by a seed and keys: 13 hexadecimal digits of an md5."""
    return f"('0x' || substr(md5('{seed}:' || {" || ':' || ".join(keys)}), 1, 13))::BIGINT"


def drawn(name: str, source: str, draws: str, seed: int, capacity: int) -> str:
    """Rows of memory where cumulated priorities reach tossed values, with weights: tables drawn_<name>."""
    return f"""own_{name} AS (
  SELECT *, sum(priority) OVER (ORDER BY idx) AS reach, sum(priority) OVER () AS total FROM memory WHERE {source}
), toss_{name} AS (
  SELECT k AS draw, ({toss(seed, 'k')} + 0.5::DOUBLE) / {16**13} * (SELECT max(total) FROM own_{name}) AS s FROM range({draws}) t(k)
), hit_{name} AS (
  SELECT draw, arg_min(idx, idx) AS idx, arg_min(priority, idx) AS priority,
         pow({capacity} * arg_min(priority, idx) / max(total), -0.7::DOUBLE) AS w
  FROM toss_{name} JOIN own_{name} ON reach >= s GROUP BY draw
), drawn_{name} AS (
  SELECT draw, idx, priority, w / (SELECT max(w) FROM hit_{name}) AS weight FROM hit_{name}
)"""


def batch_rows(name: str) -> str:
    return f"SELECT '{name}' AS source, idx, round(priority, 6) AS priority, round(weight, 6) AS weight FROM drawn_{name}"


def cut_of(layout: str, layout_id: int) -> str:
    """Median cut of the fullest partition of a layout that ``layout`` names."""
    return f"""SELECT {layout_id} AS layout_id, pid, CASE WHEN tall THEN 0 ELSE 1 END AS dir, CASE WHEN tall THEN line ELSE r0 END AS i,
       CASE WHEN tall THEN c0 ELSE line END AS j,
       (CASE WHEN tall THEN 2 * (line * {N} + c0) ELSE 2 * (r0 * {N} + line) + 1 END)::INT AS action
FROM ({{}}) AS c_{layout}"""


def chosen_cut(layout: str, layout_id: int) -> str:
    return cut_of(layout, layout_id).format(f"WITH {greedy_rounds(layout, 1)} SELECT * FROM cut_1")


DEMO = "idx IN (SELECT event_id FROM events WHERE event_type = 'purchase')"
DEMO_ROWS = "(SELECT least(8, count(*)) FROM events WHERE event_type = 'purchase')"

ORACLE = {
    "q_sample_k": f"""WITH {MEMORY}
SELECT idx, round(priority, 6) AS priority, 1.0::DOUBLE AS weight FROM memory ORDER BY {toss(7, 'idx')}, idx LIMIT 32""",
    "q_priority_sample": f"""WITH {MEMORY}, {drawn('all', 'true', '32', 7, 10_000)}
SELECT draw, idx, round(priority, 6) AS priority, round(weight, 6) AS weight FROM drawn_all""",
    "q_mixed_batch": f"""WITH {MEMORY}, {drawn('demo', DEMO, DEMO_ROWS, 7, 100)}, {drawn('agent', f'NOT {DEMO}', f'32 - {DEMO_ROWS}', 8, 10_000)}
{batch_rows('demo')} UNION ALL {batch_rows('agent')}""",
    "q_random_cut": f"""WITH {EVEN}, cuts AS ({CUTS_OF.format(layout='lay')}), acts AS (
  SELECT (2 * (i * {N} + j) + dir)::INT AS action FROM cuts
) SELECT 0 AS layout_id, action FROM acts ORDER BY {toss(7, "'0'", 'action')}, action LIMIT 1""",
    "q_points_roundtrip": f"WITH {POINTS} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM pts",
    "q_vector_roundtrip": """
WITH users AS (SELECT user_id, avg(value) AS mean FROM events GROUP BY user_id)
SELECT (row_number() OVER (ORDER BY user_id % 2, user_id) - 1)::INT AS idx, round(mean, 6) AS value FROM users""",
    "q_costs_roundtrip": f"""WITH {TRIALS}
SELECT 0 AS run, qid, round(max(seconds), 6) AS seconds, 'ok' AS status FROM costs GROUP BY qid
UNION ALL SELECT 1, NULL, NULL, 'aborted'""",
    "q_layout_roundtrip": f"""WITH {EVEN}, {BOXES}
SELECT l.pid, l.c0, l.c1, l.r0, l.r1, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x,
       round(min_y, 6) AS min_y, round(max_y, 6) AS max_y, count(c.id) AS n
FROM boxes l LEFT JOIN cells c ON {IN_PART} GROUP BY ALL""",
    "q_log_roundtrip": f"WITH {STEPS} SELECT episode, round(reward, 6) AS reward FROM totals",
    "q_transitions_roundtrip": f"""WITH {STEPS}, kinds AS (
  SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, event_type FROM events
) SELECT episode, step, round(reward, 6) AS reward, done, true AS is_demo FROM steps JOIN kinds USING (episode, step)
WHERE event_type = 'purchase'""",
    "q_search_two_parts": f"""WITH {GRID}, {WORKLOAD}, root(pid, c0, c1, r0, r1) AS (VALUES (0, 0, {N}, 0, {N})),
cuts AS ({CUTS_OF.format(layout='root')}), lay AS (
  SELECT (2 * (i * {N} + j) + dir)::INT AS action, 0 AS pid, 0 AS c0, CASE WHEN dir = 1 THEN j ELSE {N} END AS c1,
         0 AS r0, CASE WHEN dir = 0 THEN i ELSE {N} END AS r1 FROM cuts
  UNION ALL
  SELECT (2 * (i * {N} + j) + dir)::INT, 1, CASE WHEN dir = 1 THEN j ELSE 0 END, {N}, CASE WHEN dir = 0 THEN i ELSE 0 END, {N} FROM cuts
), {BOXES}, loads AS (
  SELECT b.action, b.pid, w.qid, any_value(rate) AS rate, count(p.id) AS m,
         (SELECT count(*) FROM cells c WHERE c.j >= b.c0 AND c.j < b.c1 AND c.i >= b.r0 AND c.i < b.r1) AS n
  FROM boxes b CROSS JOIN workload w LEFT JOIN pts p ON {overlap('w.distance / 110000')}
  GROUP BY b.action, b.pid, w.qid, b.c0, b.c1, b.r0, b.r1
), worst AS (
  SELECT action, qid, max(n * m) * any_value(rate) AS top FROM loads GROUP BY action, qid
), costs AS (
  SELECT action, sum(top) AS cost, (row_number() OVER (ORDER BY sum(top), action) - 1)::INT AS layout_id FROM worst GROUP BY action
) SELECT layout_id, pid, c0, c1, r0, r1, round(cost, 6) AS cost FROM costs JOIN lay USING (action)""",
    "q_bbox": f"""WITH {POINTS}
SELECT round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y, round(max_y, 6) AS max_y FROM bb""",
    "q_bbox_compat": f"""WITH {POINTS}
SELECT round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y,
       round((SELECT floor(max(y) * 100000::DOUBLE) / 100000 FROM pts), 6) AS max_y FROM bb""",
    "q_grid_lines": f"WITH {GRID} SELECT axis, idx, round(v, 6) AS value FROM lines",
    "q_point_cells": f"WITH {GRID} SELECT id, i, j FROM cells",
    "q_grid_histogram": f"""WITH {GRID}
SELECT a.idx AS i, b.idx AS j, count(c.id) AS n, round(count(c.id) / (SELECT count(*) FROM pts)::DOUBLE, 6) AS density
FROM strips a JOIN strips b ON a.axis = 'y' AND b.axis = 'x' LEFT JOIN cells c ON c.i = a.idx AND c.j = b.idx
GROUP BY a.idx, b.idx""",
    "q_grid_histogram_closed": f"""WITH {GRID}
SELECT a.idx AS i, b.idx AS j, count(p.id) AS n, round(count(p.id) / (SELECT count(*) FROM pts)::DOUBLE, 6) AS density
FROM strips a JOIN strips b ON a.axis = 'y' AND b.axis = 'x'
LEFT JOIN pts p ON p.y BETWEEN a.lo AND a.hi AND p.x BETWEEN b.lo AND b.hi
GROUP BY a.idx, b.idx""",
    "q_cell_weight": f"""WITH {GRID}, hist AS (
  SELECT a.idx AS i, b.idx AS j, count(c.id) AS n
  FROM strips a JOIN strips b ON a.axis = 'y' AND b.axis = 'x' LEFT JOIN cells c ON c.i = a.idx AND c.j = b.idx
  GROUP BY a.idx, b.idx
) SELECT i, j, round(n / (SELECT max(n) FROM hist)::DOUBLE, 6) AS weight FROM hist""",
    "q_minmax_scale": f"""WITH {POINTS}, ends AS (SELECT min(y) AS a, max(y) AS b FROM pts)
SELECT id, round((y - a) / (b - a), 6) AS scaled FROM pts, ends""",
    "q_nearest_line": f"""WITH {GRID}
SELECT id, arg_min(idx, abs(v - x) ORDER BY idx) AS line
FROM pts JOIN lines ON axis = 'x' AND idx BETWEEN 1 AND {N - 1} GROUP BY id""",
    "q_root_cuts": f"WITH {ROOT_CUTS} SELECT 0 AS layout_id, pid, dir, i, j, action, n_low FROM counted",
    "q_layout_cuts": f"""WITH {STATS}, cuts AS ({CUTS_OF.format(layout='lay')})
SELECT 0 AS layout_id, c.pid, dir, i, j, (2 * (i * {N} + j) + dir)::INT AS action, n
FROM cuts c JOIN stats s ON c.pid = s.pid""",
    "q_replay_layout": f"""WITH {GRID}, {layout_values(MIXED_CUTS)}, {BOXES}
SELECT l.pid, l.c0, l.c1, l.r0, l.r1, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x,
       round(min_y, 6) AS min_y, round(max_y, 6) AS max_y, count(c.id) AS n
FROM boxes l LEFT JOIN cells c ON {IN_PART} GROUP BY ALL""",
    "q_apply_cuts": f"""WITH {ROOT_CUTS}, made AS (
  SELECT action AS layout_id, 0 AS pid, 0 AS c0, CASE WHEN dir = 1 THEN j ELSE {N} END AS c1,
         0 AS r0, CASE WHEN dir = 0 THEN i ELSE {N} END AS r1 FROM counted
  UNION ALL
  SELECT action, 1, CASE WHEN dir = 1 THEN j ELSE 0 END, {N}, CASE WHEN dir = 0 THEN i ELSE 0 END, {N} FROM counted
) SELECT layout_id, pid, c0, c1, r0, r1, count(c.id) AS n FROM made l LEFT JOIN cells c ON {IN_PART} GROUP BY ALL""",
    "q_median_cut_1": f"""WITH {GRID}, root(pid, c0, c1, r0, r1) AS (VALUES (0, 0, {N}, 0, {N})), {greedy_rounds('root', 1)}
SELECT pid, CASE WHEN tall THEN 0 ELSE 1 END AS dir, CASE WHEN tall THEN line ELSE r0 END AS i,
       CASE WHEN tall THEN c0 ELSE line END AS j,
       (CASE WHEN tall THEN 2 * (line * {N} + c0) ELSE 2 * (r0 * {N} + line) + 1 END)::INT AS action
FROM cut_1""",
    "q_greedy_layout": f"""WITH {GREEDY}
SELECT l.pid, l.c0, l.c1, l.r0, l.r1, count(c.id) AS n,
       round(count(c.id) / (SELECT count(*) FROM pts)::DOUBLE, 6) AS share
FROM lay_7 l LEFT JOIN cells c ON {IN_PART} GROUP BY ALL""",
    "q_cell_owner": f"""WITH {EVEN}
SELECT c.i, c.j, l.pid, count(*) AS n FROM cells c JOIN lay l ON {IN_PART} GROUP BY ALL""",
    "q_raster": f"""WITH {STATS}, hist AS (SELECT i, j, count(*) AS n FROM cells GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE AS t, (SELECT max(n) FROM hist)::DOUBLE AS top FROM pts)
SELECT a.idx AS i, b.idx AS j,
  CASE WHEN (a.idx = {N} AND b.idx < {N}) OR EXISTS (
    SELECT 1 FROM lay l WHERE l.r0 = a.idx AND b.idx >= l.c0 AND b.idx < l.c1) THEN 1 ELSE 0 END AS h_line,
  CASE WHEN (b.idx = {N} AND a.idx < {N}) OR EXISTS (
    SELECT 1 FROM lay l WHERE l.c0 = b.idx AND a.idx >= l.r0 AND a.idx < l.r1) THEN 1 ELSE 0 END AS v_line,
  round(coalesce(h.n / total.top * (s.n / total.t), 0), 6) AS weight
FROM lines a JOIN lines b ON a.axis = 'y' AND b.axis = 'x' CROSS JOIN total
LEFT JOIN hist h ON h.i = a.idx AND h.j = b.idx
LEFT JOIN stats s ON a.idx >= s.r0 AND a.idx < s.r1 AND b.idx >= s.c0 AND b.idx < s.c1""",
    "q_same_layout": f"""WITH {GREEDY}, {layout_values(MIXED_CUTS)}
SELECT *, 'left' AS side FROM (SELECT pid, c0, c1, r0, r1 FROM lay_7 EXCEPT ALL SELECT pid, c0, c1, r0, r1 FROM lay)
UNION ALL
SELECT *, 'right' FROM (SELECT pid, c0, c1, r0, r1 FROM lay EXCEPT ALL SELECT pid, c0, c1, r0, r1 FROM lay_7)""",
    "q_best_cut": f"""WITH {ROOT_CUTS}, total AS (SELECT count(*) AS t FROM pts)
SELECT action, -abs(2 * n_low - t) AS score FROM counted, total WHERE n_low > 0 AND n_low < t
ORDER BY score DESC, action LIMIT 1""",
    "q_shift_cut": f"""WITH {CHOSEN}, cuts AS ({CUTS_OF.format(layout='lay')}), legal AS (
  SELECT (2 * (i * {N} + j) + dir)::INT AS action FROM cuts
), moved AS (
  SELECT mode, action, s::INT AS shift,
    (action + CASE WHEN (action % 2 = 0) = (mode = 'anchor') THEN 2 * s ELSE 2 * s * {N} END)::INT AS target
  FROM chosen, (VALUES ('anchor'), ('line')) m(mode), (VALUES (-2), (-1), (1), (2)) t(s)
) SELECT mode, m.action, shift, coalesce(l.action, m.action) AS shifted
FROM moved m LEFT JOIN legal l ON l.action = m.target""",
    "q_assign_partitions": f"WITH {EVEN} SELECT c.id, l.pid FROM cells c JOIN lay l ON {IN_PART}",
    "q_partition_by_layout": f"WITH {EVEN} SELECT c.id, l.pid FROM cells c JOIN lay l ON {IN_PART}",
    "q_partition_stats": f"""WITH {STATS}
SELECT pid, n, round(n / (SELECT count(*) FROM pts)::DOUBLE, 6) AS share FROM stats""",
    "q_partition_stats_closed": f"""WITH {EVEN}, {BOXES}
SELECT pid, count(p.id) AS n, round(count(p.id) / (SELECT count(*) FROM pts)::DOUBLE, 6) AS share
FROM boxes LEFT JOIN pts p ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY pid""",
    "q_partition_medians": f"""WITH {EVEN}
SELECT l.pid, round(coalesce(median(c.x), 0), 6) AS median_x, round(coalesce(median(c.y), 0), 6) AS median_y
FROM lay l LEFT JOIN cells c ON {IN_PART} GROUP BY l.pid""",
    "q_assign_closed_fine": f"WITH {FINE_BOXES} SELECT id, pid FROM pts JOIN boxes ON {FINE_CLOSED}",
    "q_partition_medians_closed_fine": f"""WITH {FINE_BOXES}
SELECT pid, round(coalesce(median(x), 0), 6) AS median_x, round(coalesce(median(y), 0), 6) AS median_y
FROM boxes LEFT JOIN pts ON {FINE_CLOSED} GROUP BY pid""",
    "q_circles_fine": f"""WITH {FINE_BOXES}
SELECT pid, count(*) AS m FROM boxes JOIN pts ON {overlap(f'{RADIUS}::DOUBLE', FINE)} GROUP BY pid""",
    "q_fullest_partition": f"WITH {STATS} SELECT pid, n FROM stats ORDER BY n DESC, pid LIMIT 1",
    "q_circles_per_partition": f"""WITH {EVEN}, {BOXES}
SELECT pid, count(*) AS m FROM boxes JOIN pts ON {overlap(f'{RADIUS}::DOUBLE')} GROUP BY pid""",
    "q_distance_join": NEAR + "SELECT * FROM pairs",
    "q_distance_join_layout": NEAR + "SELECT * FROM pairs",
    "q_distance_join_grouped": grouped(10_000),
    "q_distance_join_grouped_parts": grouped(4),
    "q_distance_join_two_sided": NEAR + """
SELECT circle_id, point_id FROM pairs JOIN events ON event_id = circle_id WHERE event_type = 'purchase'""",
    "q_distance_join_placed": f"WITH {POINTS}" + "".join(
        f""", near_{k} AS (
  SELECT {r}::DOUBLE AS radius, a.id AS circle_id, count(*) AS n FROM pts a, pts b
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r}::DOUBLE * {r}::DOUBLE GROUP BY a.id
)"""
        for k, r in enumerate(RADII)
    ) + " SELECT * FROM near_0 UNION ALL SELECT * FROM near_1 UNION ALL SELECT * FROM near_2",
    "q_distance_join_placed_split": NEAR + """
SELECT circle_id, point_id FROM pairs JOIN events ON event_id = circle_id WHERE event_type = 'purchase'""",
    "q_distance_join_two_layouts": NEAR + "SELECT layout_id, circle_id, point_id FROM pairs, (VALUES (0), (1)) l(layout_id)",
    "q_distance_join_hub": """
WITH placed AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)
SELECT 7::BIGINT AS circle_id, (place // 64)::INT AS part, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS point_ids,
       (SELECT count(*) FROM events) AS n FROM placed GROUP BY part""",
    "q_median_cuts_two_layouts": f"""WITH {EVEN}, {layout_values(MIXED_CUTS, "other")}
{chosen_cut("lay", 0)} UNION ALL {chosen_cut("other", 1)}""",
    "q_metres_join": f"WITH {pairs('(5000 / 110000::DOUBLE)')} SELECT circle_id, count(*) AS n FROM pairs GROUP BY circle_id",
    "q_median_trials": f"WITH {TRIALS} SELECT layout_id, qid, round(seconds, 6) AS seconds FROM costs",
    "q_workload_cost": f"WITH {TRIALS} SELECT layout_id, round(cost, 8) AS cost, status FROM evals",
    "q_total_query_time": f"WITH {TRIALS} SELECT round(sum(seconds), 3) AS seconds FROM trials",
    "q_best_so_far": f"""WITH {TRIALS}
SELECT seq, round(cost, 8) AS cost, round(best_before, 8) AS best_before, improved,
       round(CASE WHEN status = 'aborted' THEN 0.2::DOUBLE ELSE pow(coalesce(best_before, cost) / cost, 2) END, 6) AS reward
FROM marked""",
    "q_best_costs": f"""WITH {TRIALS}
SELECT m.seq, c.qid, round((
    SELECT arg_max(b.seconds, l.seq) FROM marked l JOIN costs b ON b.layout_id = l.layout_id
    WHERE l.leads AND l.seq < m.seq AND b.qid = c.qid), 6) AS budget
FROM costs c JOIN marked m ON m.layout_id = c.layout_id""",
    "q_improvements": f"""WITH {TRIALS}
SELECT seq, sum(improved::INT) OVER (ORDER BY seq)::BIGINT AS improvements FROM marked""",
    "q_estimate_cost": f"WITH {LOADS} SELECT qid, pid, n, m, n * m AS load FROM loads",
    "q_layout_cost": f"""WITH {LOADS}, worst AS (
  SELECT qid, max(n * m) AS top, sum(n * m) AS total FROM loads GROUP BY qid
) SELECT 'max' AS how, round(sum(top * rate), 6) AS cost FROM worst JOIN workload USING (qid)
UNION ALL SELECT 'sum', round(sum(total::DOUBLE * rate), 6) FROM worst JOIN workload USING (qid)""",
    "q_nstep": f"""WITH {STEPS}
SELECT episode, step, round(reward + 0.99::DOUBLE * coalesce(lead(reward) OVER w, 0)
         + 0.9801::DOUBLE * coalesce(lead(reward, 2) OVER w, 0), 8) AS nstep_reward
FROM steps WINDOW w AS (PARTITION BY episode ORDER BY step)""",
    "q_nstep_state": f"""WITH {STEPS}
SELECT episode, step, round(reward + 0.99::DOUBLE * coalesce(lead(reward) OVER w, 0)
         + 0.9801::DOUBLE * coalesce(lead(reward, 2) OVER w, 0), 8) AS nstep_reward,
       round(lead(reward, 3) OVER w, 6) AS next_state
FROM steps WINDOW w AS (PARTITION BY episode ORDER BY step)""",
    "q_rolling_mean": """
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 10 THEN round(
  avg(value) OVER (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) END AS rolling_mean
FROM events""",
    "q_streak": """
WITH marked AS (
  SELECT event_id, event_type <> 'error' AS hit,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS misses
  FROM events
), runs AS (
  SELECT event_id, sum(hit::INT) OVER (PARTITION BY misses ORDER BY event_id)::BIGINT AS streak FROM marked
) SELECT * FROM runs
WHERE event_id <= coalesce((SELECT min(event_id) FROM runs WHERE streak >= 10), (SELECT max(event_id) FROM runs))""",
    "q_retain_latest": """
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1000""",
    "q_every_kth": f"WITH {STEPS} SELECT episode, round(reward, 6) AS reward FROM totals WHERE (episode + 1) % 10 = 0",
    "q_episode_totals": f"WITH {STEPS} SELECT episode, round(reward, 6) AS reward FROM totals",
    "q_priority": f"WITH {MEMORY} SELECT idx, round(priority, 6) AS priority FROM memory",
    "q_initial_priority": f"""WITH {MEMORY}
SELECT idx, round(coalesce(max(priority) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 6)
  AS initial_priority FROM memory""",
    "q_weighted_lookup": f"""WITH {MEMORY}
SELECT draw, h.idx, round(priority, 6) AS priority FROM hits h JOIN memory m ON m.idx = h.idx""",
    "q_weighted_lookup_heavy": f"""WITH {MEMORY}, heavy AS (
  SELECT idx, CASE WHEN idx = 300 THEN 1e12::DOUBLE ELSE round(priority, 3) END AS priority FROM memory
), reach AS (
  SELECT *, sum(priority) OVER (ORDER BY idx) AS far FROM heavy
), tosses AS (
  SELECT k AS draw, (SELECT sum(priority) FROM heavy) * (k + 0.5::DOUBLE) / 32 AS s FROM range(32) t(k)
  UNION ALL
  SELECT k + 100, k * 2.5::DOUBLE + 0.3::DOUBLE FROM range(64) t(k)
), met AS (
  SELECT draw, min(idx) AS idx FROM tosses JOIN reach ON far >= s GROUP BY draw
) SELECT draw, idx, round(priority, 6) AS priority FROM met JOIN heavy USING (idx)""",
    "q_priority_weights": f"""WITH {MEMORY}, raw AS (
  SELECT draw, h.idx, pow(10000 * priority / (SELECT sum(priority) FROM memory), -0.7::DOUBLE) AS w
  FROM hits h JOIN memory m ON m.idx = h.idx
) SELECT draw, idx, round(w / (SELECT max(w) FROM raw), 6) AS weight FROM raw""",
    "q_update_priorities": f"""WITH {MEMORY}
SELECT idx, round(CASE WHEN event_type = 'view' THEN pow(value / 10 + 0.0001::DOUBLE, 0.6::DOUBLE) ELSE priority END, 6)
  AS priority FROM memory JOIN events ON event_id = idx""",
    "q_route_transitions": f"""WITH {STEPS}, better AS (
  SELECT episode, coalesce(reward < min(reward) OVER (
    ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS improved
  FROM totals
) SELECT episode, step, improved AS is_demo FROM steps JOIN better USING (episode)""",
}
