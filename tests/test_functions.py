import math

import pytest
from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators import grid as G


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("value", [1.234567, -1.234567, 49.0021, 0.0, -124.847011])
def test_round_off_goes_outward(spark, value):
    assert one(spark, S.round_off(F.lit(value), 5, True)) == math.ceil(value * 10**5) / 10**5
    assert one(spark, S.round_off(F.lit(value), 5, False)) == math.floor(value * 10**5) / 10**5


def test_cut_codes(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("ijd", S.decode_cut(F.lit(1240), 30))]).first()
    assert (row.i, row.j, row.d) == (20, 20, 0)
    codes = spark.range(1800).select("id", *[c.alias(n) for n, c in zip("ijd", S.decode_cut(F.col("id"), 30))])
    back = codes.select("id", S.encode_cut(F.col("i"), F.col("j"), F.col("d"), 30).alias("code"))
    assert back.filter("id <> code").count() == 0


def test_boundaries(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (0.5, 1.0), (1.0, 1.0)], "x double, y double")
    box = (0.0, 1.0, 0.0, 1.0)
    assert rows.filter(S.in_box(F.col("x"), F.col("y"), box)).count() == 4
    assert rows.filter(S.in_box(F.col("x"), F.col("y"), box, "half_open")).count() == 1


def test_rewards(spark):
    assert one(spark, S.reward(F.lit(25.0), F.lit(22.5), F.lit("ok"))) == pytest.approx(1.234568, abs=1e-6)
    assert one(spark, S.reward(F.lit(25.0), F.lit(None).cast("double"), F.lit("aborted"))) == 0.2


def test_priority_and_degrees(spark):
    assert one(spark, S.priority(F.lit(-2.0))) == pytest.approx(2.0001**0.6)
    assert one(spark, S.metres_to_degrees(F.lit(5000))) == pytest.approx(5000 / 110000)


def test_nearest_index_prefers_the_lowest(spark):
    lines = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(float(k)).alias("value")) for k in (3, 2, 1)])
    assert one(spark, S.nearest_index(lines, F.lit(2.5))) == 2


def test_grid_lines_and_cells(spark):
    grid = G.make_grid((-124.84701, -66.88805, 24.43357, 49.38418))
    lines = {(r.axis, r.idx): r.value for r in G.grid_lines(spark, grid).collect()}
    assert len(lines) == 62
    assert lines["x", 30] == -66.88805 and lines["y", 0] == 24.43357
    # A point on a line belongs to the cell above it, and the last line to the last cell.
    on_lines = [(k, v) for (axis, k), v in lines.items() if axis == "x"]
    rows = spark.createDataFrame(on_lines, "k int, x double").withColumn("j", G.cell_index("x", grid, "x"))
    assert all(r.j == min(r.k, 29) for r in rows.collect())
    below = rows.select("k", (F.col("x") - 1e-9).alias("x")).withColumn("j", G.cell_index("x", grid, "x"))
    assert all(r.j == max(r.k - 1, 0) for r in below.collect())


def test_minmax_scale_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r.scaled for r in G.minmax_scale(rows, "v").collect()} == {None}


def test_degenerate_box(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 3.0)], "id long, x double, y double")
    grid = G.make_grid(G.bounding_box(rows), 3, 3)
    cells = {(r.i, r.j): r.n for r in G.grid_histogram(rows, grid).collect()}
    assert sum(cells.values()) == 2 and len(cells) == 9
