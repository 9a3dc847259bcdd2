import tempfile

import pytest
from pyspark.sql import functions as F

from tests.test_layouts import BOX, CUTS, EDGES
from tilewright.operators import grid as G
from tilewright.operators import layout as L
from tilewright.session import cut_lineage, local_table, pin
from tilewright.sources.layouts import read_layout, write_layout
from tilewright.sources.points import read_points, spread_points
from tilewright.sources.tables import read_log, read_transitions, write_log, write_transitions
from tilewright.sources.vectors import (
    read_costs,
    read_vector,
    workload_table,
    write_costs,
    write_vector,
)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_points_files(spark, folder):
    path = f"{folder}/points.csv"
    with open(path, "w") as f:
        f.write("-100.5,30.25\n-99.0,31.0\n-100.5,30.25\n")
    rows = read_points(spark, path).collect()
    assert sorted((r.x, r.y) for r in rows) == [(-100.5, 30.25), (-100.5, 30.25), (-99.0, 31.0)]
    assert len({r.id for r in rows}) == 3
    assert {(r.x, r.y) for r in read_points(spark, path, order="yx").collect()} == {(30.25, -100.5), (31.0, -99.0)}
    with open(f"{folder}/with_id.csv", "w") as f:
        f.write("1.0,2.0,77\n")
    assert read_points(spark, f"{folder}/with_id.csv", id_col="key").first() == (77, 1.0, 2.0)
    spread = spread_points(read_points(spark, path), 4)
    assert spread.rdd.getNumPartitions() == 4 and spread.storageLevel.useMemory
    spread.unpersist()


def test_vector_files(spark, folder):
    path = f"{folder}/query.csv"
    with open(path, "w") as f:
        f.write("500\r\n1000\r\n 5000 \r\n")
    assert [(r.idx, r.value) for r in read_vector(spark, path).collect()] == [(0, 500.0), (1, 1000.0), (2, 5000.0)]
    workload = workload_table(spark, [500, 1000, 5000], [0.25, 0.5, 0.25])
    write_vector(workload, f"{folder}/out", "qid", "distance")
    assert [r.value for r in read_vector(spark, f"{folder}/out").orderBy("idx").collect()] == [500.0, 1000.0, 5000.0]
    for text in ("", "\n"):
        with open(path, "w") as f:
            f.write(text)
        assert read_vector(spark, path).count() == 0


def test_cost_files(spark, folder):
    costs = local_table(spark, [(1, 2.5), (0, 1.25)], "qid int, seconds double")
    write_costs(costs, f"{folder}/costs")
    assert [(r.qid, r.seconds, r.status) for r in read_costs(spark, f"{folder}/costs").orderBy("qid").collect()] == [
        (0, 1.25, "ok"), (1, 2.5, "ok"),
    ]
    stopped = costs.withColumn("status", F.when(F.col("qid") == 1, "aborted").otherwise("ok"))
    write_costs(stopped, f"{folder}/stopped")
    assert read_vector(spark, f"{folder}/stopped").count() == 0
    assert [(r.seconds, r.status) for r in read_costs(spark, f"{folder}/stopped").collect()] == [(None, "aborted")]


def test_layout_files(spark, folder):
    grid = G.make_grid(BOX)
    layout = L.replay_cuts(spark, grid, CUTS)
    write_layout(layout, f"{folder}/layout")
    back = read_layout(spark, f"{folder}/layout", grid)
    assert L.same_layout(layout, back)
    assert [(r.min_x, r.max_x, r.min_y, r.max_y) for r in back.orderBy("pid").collect()] == EDGES
    with open(f"{folder}/crlf.csv", "w", newline="") as f:
        f.write("".join(",".join(map(str, e)) + "\r\n" for e in EDGES))
    assert L.same_layout(layout, read_layout(spark, f"{folder}/crlf.csv", grid))


def test_logs_and_transitions(spark, folder):
    ddl = "episode bigint, reward double, loss_n double, loss_e double, loss_l2 double, loss_all double, best_cost double"
    log = local_table(spark, [(0, 1.0, 0.1, 0.2, 0.3, 0.6, 9.5), (1, 2.0, 0.1, 0.2, 0.3, 0.6, 9.0)], ddl)
    write_log(log, f"{folder}/log")
    assert L.same_layout(log, read_log(spark, f"{folder}/log"), log.columns)
    rows = local_table(
        spark,
        [(0, 0, 41, 0.0, False, True, [0.0, 1.0], [1.0, 1.0], 0.5), (1, 0, 31, 1.0, True, False, [0.0], None, 0.1)],
        "episode bigint, step bigint, action bigint, reward double, done boolean, is_demo boolean, "
        "state array<double>, next_state array<double>, td_error double",
    )
    write_transitions(rows, f"{folder}/memory")
    assert L.same_layout(rows, read_transitions(spark, f"{folder}/memory"), rows.columns)
    demo = read_transitions(spark, f"{folder}/memory", is_demo=True)
    assert [r.episode for r in demo.collect()] == [0]
    assert "is_demo" in demo._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_pinned_tables(spark):
    table = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    small = pin(table)
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()
    assert L.same_layout(small, table, ["id", "v"])
    large = pin(table, limit=3)
    assert "Scan ExistingRDD" in large._jdf.queryExecution().executedPlan().toString()
    assert L.same_layout(large, table, ["id", "v"])
    assert cut_lineage(table).count() == 10


def test_folders_of_several_files_are_numbered_through(spark, folder):
    import os

    os.makedirs(f"{folder}/many")
    for name, lines in (("a.csv", "1.5\n2.5\n"), ("b.csv", "\n"), ("c.csv", "3.5 4.5")):
        with open(f"{folder}/many/{name}", "w") as f:
            f.write(lines)
    got = sorted((r.idx, r.value) for r in read_vector(spark, f"{folder}/many").collect())
    assert got == [(0, 1.5), (1, 2.5), (2, 3.5), (3, 4.5)]
    grid = G.make_grid(BOX)
    os.makedirs(f"{folder}/parts")
    for k in (0, 1):
        with open(f"{folder}/parts/{k}.csv", "w") as f:
            f.write("".join(",".join(map(str, e)) + "\n" for e in EDGES[4 * k : 4 * k + 4]))
    assert L.same_layout(L.replay_cuts(spark, grid, CUTS), read_layout(spark, f"{folder}/parts", grid))
