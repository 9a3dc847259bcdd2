"""Connected components of an edge table, by large-star and small-star rounds.

Every round hangs the neighbours of each node on the smallest of them; edges never grow in
number and the rounds follow the logarithm of the longest chain. Nodes with very many
neighbours are no burden: their minimum is a partial aggregate, and the joins deal skewed
keys anew. Each round is a written table, so lost executors cost no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of an edge with two ends.

    ``edges`` has the long columns a and b, in any order and any number of times. Edges
    with a null end and loops are left out.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = write_table(now.where("a is not null and b is not null and u <> v").distinct(), "edges")
    mark = None
    while True:
        now = write_table(_small_star(_large_star(now)), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select("v", F.col("v").alias("component")).distinct())
