"""Session helpers shared by all operators: size limits, small tables, lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A table known to hold at most this many narrow rows may be held on the driver
# and broadcast. Everything larger stays a distributed table.
SMALL_ROWS = 100_000

# Rows of a block in which windows of a fixed number of rows are computed. Sort and window of a
# block take some 170 bytes a row, and a task may get several blocks.
BLOCK_ROWS = 500_000

ARROW_TYPES = {
    "boolean": pa.bool_(),
    "tinyint": pa.int8(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<array<double>>": pa.list_(pa.list_(pa.float64())),
    "array<struct<c0:int,c1:int,r0:int,r1:int>>": pa.list_(
        pa.struct([(name, pa.int32()) for name in ("c0", "c1", "r0", "r1")])
    ),
}


def local_table(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """Turn a short list of tuples into a DataFrame that Catalyst sees as a local relation."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) or [() for _ in schema.fields]
    arrays = [
        pa.array(c, type=ARROW_TYPES[f.dataType.simpleString()])
        for c, f in zip(columns, schema.fields)
    ]
    table = pa.Table.from_arrays(arrays, names=schema.fieldNames())
    return spark.createDataFrame(table, schema=schema)


def collect_small(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """Rows of ``df`` when there are at most ``limit`` of them, otherwise None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def pin(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Fix a derived table that several later plans read.

    A table within ``limit`` rows becomes a local relation, which costs nothing
    to re-read and cannot be lost with an executor. A larger one is written to
    the checkpoint folder.
    """
    simple = all(f.dataType.simpleString() in ARROW_TYPES for f in df.schema.fields)
    rows = collect_small(df, limit) if simple else None
    if rows is None:
        return cut_lineage(df)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    plain = [tuple(r.asDict(recursive=True).values()) for r in rows]
    return local_table(df.sparkSession, plain, ddl)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in
    tests, a folder beside the session's tables in the warehouse serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage, survives lost executors, and gives later plans the size of
    the table, so that Spark decides by that size whether to broadcast it.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def code_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    here = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, known)))


def shuffle_slots(spark: SparkSession) -> int:
    """Number of partitions the session uses for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def literal_array(values: Sequence, element: str) -> F.Column:
    """Array literal for a lookup by position, for example one value per grid cell.

    Written as one string so that Catalyst folds it to a single constant.
    """
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{element}>")
