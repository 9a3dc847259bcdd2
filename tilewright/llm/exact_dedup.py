"""Exact deduplication: quotient filters find repeated fingerprints, bytes decide.

1. One pass writes a narrow table: id, length, digest and 64-bit fingerprint of the
   normalised text.
2. Each task builds counting quotient filters of its fingerprints, one per slab (a range
   of leading bits). The filters of a slab meet in one task and merge by their sorted
   remainders. What counts above one is a repeated fingerprint.
3. Only texts with such a fingerprint are read again and grouped by their own bytes, so
   two texts that merely share a fingerprint stay apart.

Copies collapse inside each task before anything is shuffled, so a group that holds a
third of all rows costs one row per task. Filters hold eight bytes or so per distinct
fingerprint of a task; a merging task holds one slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, whole_text
from tilewright.llm.quotient_filter import QuotientFilter, built, merged
from tilewright.session import shuffle_slots, write_table

#: Fingerprints that a task gathers before it turns them into filters.
FILTER_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """Text without the white space characters of ASCII."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def repeated_fingerprints(rows: DataFrame, column: str = "fingerprint", slab_bits: int | None = None) -> DataFrame:
    """Fingerprints that occur more than once in ``rows``, with their counts.

    ``slab_bits`` leading bits choose the slab; by default there are about four slabs
    per shuffle partition, so slabs stay small when partitions follow the input.
    """
    bits = slab_bits or max(4, (4 * shuffle_slots(rows.sparkSession)).bit_length())
    rest = 64 - bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slabs(parts: list[np.ndarray]) -> pa.RecordBatch:
            values = np.sort(np.concatenate(parts))
            slab = (values >> np.uint64(rest)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, slab[1:] != slab[:-1]))
            inner = np.split(values & np.uint64((1 << rest) - 1), edges[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array(slab[edges], pa.int64()), pa.array([built(x, rest).to_bytes() for x in inner], pa.binary())],
                names=["slab", "filter"],
            )

        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                held += batch.num_rows
            if held >= FILTER_ROWS:
                yield slabs(parts)
                parts, held = [], 0
        if held:
            yield slabs(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(slab: int, filters: list[bytes]) -> pa.RecordBatch:
            values, counts = merged([QuotientFilter.from_bytes(x) for x in filters])
            many = counts > 1
            whole = values[many] | np.uint64(slab << rest)
            return pa.RecordBatch.from_arrays(
                [pa.array(whole.view(np.int64)), pa.array(counts[many], pa.int64())], names=["fingerprint", "n"]
            )

        now, held = None, []
        for batch in batches:
            for slab, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slab != now and held:
                    yield counted(now, held)
                    held = []
                now = slab
                held.append(data)
        if held:
            yield counted(now, held)

    filters = rows.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    filters = filters.mapInArrow(build, "slab long, filter binary")
    dealt = filters.repartition(shuffle_slots(rows.sparkSession), "slab").sortWithinPartitions("slab")
    return dealt.mapInArrow(merge, "fingerprint long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, code (xxhash64 of the text as it is).

    Texts are equal when identical after their ASCII white space is deleted. The row with
    the most code points in its original text stays, among those the smallest id. Null
    text counts as empty. A null id sorts behind all others and is kept only if the group has no other
    id. Rows repeated under one id count each in group_size and share their fate.
    Other columns of ``docs`` are ignored.
    """
    columns_of(docs, id_col, text_col)
    whole = whole_text(text_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole).alias("code"), F.length(whole).alias("chars"), normalised(whole).alias("plain"))
    narrow = write_table(
        plain.select(
            "doc_id",
            "code",
            F.xxhash64("plain").alias("fingerprint"),
            F.unhex(F.sha2("plain", 256)).alias("digest"),
        ),
        "narrow",
    )
    repeated = write_table(repeated_fingerprints(narrow).select("fingerprint"), "repeated")
    suspects = plain.withColumn("fingerprint", F.xxhash64("plain")).join(repeated, "fingerprint", "left_semi")
    # Grouping by the text itself compares whole texts byte by byte.
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "chars", (-F.col("doc_id")).alias("less")))
    groups = suspects.groupBy("fingerprint", "plain").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    groups = write_table(
        groups.where("size > 1").select(
            F.unhex(F.sha2("plain", 256)).alias("digest"),
            (-F.col("best.less")).alias("keep_id"),
            F.col("size").alias("group_size"),
        ),
        "groups",
    )
    found = narrow.join(groups, "digest", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "code",
    )
