"""Best-fit packing of token sequences with large-item matching.

Lengths run from 1 to the capacity, so the number of pieces of each length is all that a
packing needs to know. That histogram, at most ``capacity`` rows at any scale, is packed on
the driver in groups of equal bins. A piece finds its place by its rank among the pieces
of its length: a task counts its own pieces per length, a running sum over tasks gives the
first rank of each task, and the place follows from the plan. No group of pieces of one
length is ever gathered, however frequent the length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, released, whole_text
from tilewright.llm.tokens import DEFAULT_TOKENIZER, ids_of
from tilewright.session import write_table


@dataclass
class Places:
    """Ranks ``first`` to ``first + bins * copies - 1`` of one length, over equal bins."""

    length: int
    first: int
    bins: int
    copies: int
    sequence: int
    offset: int


class Plan:
    """Greedy packing of a histogram of lengths, bins in groups of equal content."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, Counter({k: v for k, v in counts.items() if v})
        self.taken: Counter = Counter()  # ranks given away, per length
        self.places: list[Places] = []
        self.sequences = 0
        self.gaps: list[int] = []  # ascending, one entry per gap that has bins
        self.bins: defaultdict[int, list] = defaultdict(list)  # gap: [first sequence, bins]
        self._pair_large()
        self._fit_small()

    def _put(self, length: int, bins: int, copies: int, sequence: int, offset: int) -> None:
        self.places.append(Places(length, self.taken[length], bins, copies, sequence, offset))
        self.taken[length] += bins * copies
        self.left[length] -= bins * copies

    def _open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins

    def _keep(self, gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            if not self.bins[gap]:
                insort(self.gaps, gap)
            self.bins[gap].append([sequence, bins])

    def _pair_large(self) -> None:
        """Each piece over a third, the longest first, gets the longest such piece that fits."""
        large = sorted(k for k in self.left if 3 * k > self.capacity)
        for length in reversed(large):
            while n := self.left[length]:
                at = bisect_left(large, self.capacity - length + 1) - 1
                while at >= 0 and (large[at] > length or self.left[large[at]] < 1 + (large[at] == length)):
                    at -= 1
                if at < 0:
                    first = self._open(n)
                    self._put(length, n, 1, first, 0)
                    self._keep(self.capacity - length, first, n)
                elif (partner := large[at]) == length:
                    first = self._open(n // 2)
                    self._put(length, n // 2, 2, first, 0)
                    self._keep(self.capacity - 2 * length, first, n // 2)
                else:
                    bins = min(n, self.left[partner])
                    first = self._open(bins)
                    self._put(length, bins, 1, first, 0)
                    self._put(partner, bins, 1, first, length)
                    self._keep(self.capacity - length - partner, first, bins)

    def _fit_small(self) -> None:
        """The rest, the longest first, goes where the least room stays."""
        for length in sorted((k for k, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    bins = max(1, n // (self.capacity // length))
                    self._keep(self.capacity, self._open(bins), bins)
                    continue
                gap = self.gaps[at]
                first, there = self.bins[gap].pop()
                if not self.bins[gap]:
                    self.gaps.pop(at)
                copies = min(gap // length, n)
                bins = min(there, n // copies)
                self._keep(gap, first + bins, there - bins)
                self._put(length, bins, copies, first, self.capacity - gap)
                self._keep(gap - copies * length, first, bins)


def _places_of(plan: Plan) -> tuple[np.ndarray, ...]:
    rows = sorted(plan.places, key=lambda p: (p.length, p.first))
    key = np.array([(p.length << 48) + p.first for p in rows], np.int64)
    return key, *(np.array([getattr(p, c) for p in rows], np.int64) for c in ("first", "bins", "sequence", "offset"))


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its rank in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, task = ids_of(tokenizer), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, out = [], {c: [] for c in ("piece", "start", "length", "ids_crc32", "rank")}
            for k, value in enumerate(batch.column(1)):
                data = ids.of(value.as_buffer().to_pybytes()) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    length = len(part) // 4
                    row.append(k)
                    for c, v in zip(out, (piece, at // 4, length, zlib.crc32(part), seen[length])):
                        out[c].append(v)
                    seen[length] += 1
            kinds = [pa.int32(), *[pa.int64()] * 4]
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(row), pa.int64())], names=["doc_id", *out, "task"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, task long")


def pack(
    docs: DataFrame, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens.

    A text is its ids and then ``end_id``. Only longer ones are cut, into pieces of the
    capacity; the last may be shorter. One row per piece: doc_id, piece, start, length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), sequence_id, offset.
    Null text counts as empty: one token. Null ids and repeated rows are packed like any
    other row; other columns are ignored; no rows give no rows.
    """
    columns_of(docs, id_col, text_col)
    table = write_table(pieces(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces")
    per_task = table.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_table(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    counts = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    key, first, bins, sequence, offset = _places_of(Plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            copy, bin_ = np.divmod(rank - first[at], bins[at])
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sequence[at] + bin_), pa.array(offset[at] + copy * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = table.join(starts.drop("n"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(released(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
