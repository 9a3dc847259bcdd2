"""Episode logs and experience tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSITION_DDL = (
    "episode bigint, step bigint, action bigint, reward double, done boolean, is_demo boolean, "
    "state array<double>, next_state array<double>, td_error double"
)
LOG_DDL = (
    "episode bigint, reward double, loss_n double, loss_e double, loss_l2 double, loss_all double, "
    "best_cost double"
)


def write_log(episodes: DataFrame, path: str) -> None:
    """Episode log as CSV with a header."""
    episodes.write.mode("overwrite").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, ddl: str = LOG_DDL) -> DataFrame:
    return spark.read.option("header", True).schema(ddl).csv(path)


def write_transitions(transitions: DataFrame, path: str) -> None:
    """Experience table as parquet, one folder per memory, so a reader of one memory skips the other."""
    transitions.write.mode("overwrite").partitionBy("is_demo").parquet(path)


def read_transitions(spark: SparkSession, path: str, is_demo: bool | None = None) -> DataFrame:
    rows = spark.read.schema(TRANSITION_DDL).parquet(path)
    return rows if is_demo is None else rows.filter(F.col("is_demo") == is_demo)
