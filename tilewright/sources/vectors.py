"""Files with one number per line: workload distances and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.scalar import ABORTED, OK
from tilewright.session import local_table


def numbered(rows: DataFrame, place: str, name: str) -> DataFrame:
    """Number the rows (file, place, ...) of several files through, in the order of the files' paths.

    A file's first number is the sum of the sizes of the files before it: one row per file.
    """
    sizes = rows.groupBy("file").agg((F.max(place) + 1).alias("_n"), F.lit(0).alias("_all"))
    earlier = W.partitionBy("_all").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, "file").withColumn(name, (F.col(place) + F.col("_before")).cast("int")).drop("file", "_before")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the text of each file under ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value) in line order, over all files of a folder in the order of their names; no rows for a blank file."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    listed = whole_files(spark, path).select("file", F.posexplode(words).alias("_line", "word"))
    listed = numbered(listed.filter(F.trim("word") != ""), "_line", "idx")
    return listed.select("idx", F.trim("word").cast("double").alias("value")).orderBy("idx")


def write_vector(df: DataFrame, path: str, order: str, value: str) -> None:
    """One value per line, in order. For tables with one row per query."""
    lines = df.select(order, value).repartition(1).sortWithinPartitions(order)
    lines.select(value).write.mode("overwrite").csv(path)


def write_costs(costs: DataFrame, path: str) -> None:
    """costs(qid, seconds[, status]) as one value per line; a single blank line when aborted."""
    whole = costs if "status" in costs.columns else costs.withColumn("status", F.lit(OK))
    stopped = F.max((F.col("status") == ABORTED).cast("int"))
    line = F.when(stopped == 1, F.lit("")).otherwise(
        F.concat_ws(
            "\n",
            F.transform(
                F.array_sort(F.collect_list(F.struct("qid", "seconds"))),
                lambda c: c["seconds"].cast("string"),
            ),
        )
    )
    whole.agg(line.alias("value")).write.mode("overwrite").text(path)


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """costs(qid, seconds, status); one aborted row without a value for a blank file."""
    values = read_vector(spark, path).select(
        F.col("idx").alias("qid"), F.col("value").alias("seconds"), F.lit(OK).alias("status")
    )
    stopped = local_table(spark, [(None, None, ABORTED)], "qid int, seconds double, status string")
    some = values.agg(F.count("*") > 0).scalar()
    return values.unionByName(stopped.filter(~some))


def workload_table(spark: SparkSession, distances, rates) -> DataFrame:
    """workload(qid, distance, rate) from two parallel lists."""
    rows = [(q, float(d), float(r)) for q, (d, r) in enumerate(zip(distances, rates, strict=True))]
    return local_table(spark, rows, "qid int, distance double, rate double")
