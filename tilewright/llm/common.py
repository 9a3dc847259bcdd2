"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MASK = (1 << 64) - 1

#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def whole_text(column: str = "text") -> Column:
    """The text as it is, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


class Cache(dict):
    """Bounded memo of ``work(key)``: two generations that take about ``limit`` bytes at most.

    A key of the older generation moves on when it is used, so frequent keys stay.
    Keys longer than ``longest`` are worked out each time and never held, so entries are short:
    they are counted, at ``entry`` bytes each.
    """

    def __init__(self, work: Callable, limit: int = 32 << 20, longest: int = 64, entry: int = 190):
        super().__init__()
        self.work, self.most, self.longest, self.old = work, limit // 2 // entry, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


HELD: dict = {}


def held(kind: Hashable, make: Callable):
    """``make()`` of the kind used last in this worker process, kept over its tasks.

    A worker outlives its tasks, and memos of several operators would add up in it; asking
    for another kind lets go of the one before.
    """
    if kind not in HELD:
        HELD.clear()
        HELD[kind] = make()
    return HELD[kind]


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` for ``mapInArrow``, giving free memory back to the system when a task ends.

    Workers live on; what one operator's tasks freed would otherwise stay theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], memo: Cache) -> np.ndarray:
    """64-bit hash of each word; ``memo`` maps a word to its hash."""
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def chained(hashes: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at i, i + gaps[0], i + gaps[1], ... for every i where all exist."""
    span = gaps[-1] if gaps else 0
    n = len(hashes) - span
    if n <= 0:
        return hashes[:0]
    out = hashes[:n]
    with np.errstate(over="ignore"):
        for gap in gaps:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gap)) + hashes[gap : gap + n]
    return mixed(out)


def settled(table: DataFrame) -> DataFrame:
    """``table``, a written one, after Spark was asked to drop what its making left on disk.

    Shuffle files live until the driver's garbage is collected, by default every half hour; once a
    table is written nobody reads them any more.
    """
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()
    return table


def columns_of(df: DataFrame, *own: str) -> None:
    """Raise when ``df`` lacks one of the columns an operator reads."""
    missing = [c for c in own if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and send them texts in batches of a few MB.

    A batch is held by Spark, by Arrow and as Python values at once, so it is bounded by bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, known)))
    return spark
