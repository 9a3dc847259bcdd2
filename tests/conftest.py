import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.queries import event_points  # noqa: E402
from tilewright.operators import grid as G  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """1,000 event points."""
    df = event_points(spark, f"{DATA}/sf0.001").cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def grid(points):
    return G.make_grid(G.bounding_box(points))


@pytest.fixture(scope="session")
def clumped(spark):
    """600 points, a third of them at one place and another third close around it."""
    at = F.col("id")
    third = at % 3
    df = spark.range(600).select(
        "id",
        F.when(third == 0, 0.5).when(third == 1, 0.5 + (at % 20) / 1000).otherwise((at * 37 % 600) / 60).alias("x"),
        F.when(third == 0, 0.5).when(third == 1, 0.5 + (at % 7) / 1000).otherwise((at * 61 % 600) / 60).alias("y"),
    ).cache()
    df.count()
    return df


def brute_pairs(df, radius, other=None):
    """All pairs within the radius, by comparing every circle with every point."""
    left = df.select("id", "x", "y").toPandas().to_numpy()
    right = left if other is None else other.select("id", "x", "y").toPandas().to_numpy()
    found = set()
    for a in left:
        dx, dy = right[:, 1] - a[1], right[:, 2] - a[2]
        near = right[dx * dx + dy * dy <= radius * radius]
        found |= {(int(a[0]), int(b)) for b in near[:, 0]}
    return found


def pair_list(df):
    return [(r.circle_id, r.point_id) for r in df.collect()]


@pytest.fixture(scope="session")
def brute():
    return brute_pairs


@pytest.fixture(scope="session")
def listed():
    return pair_list
