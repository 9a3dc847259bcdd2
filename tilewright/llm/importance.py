"""Importance resampling towards a target distribution.

1. Words are hashed into buckets. One pass counts the buckets of the documents, one those of
   the target texts; tasks add up before they send, at most one row per bucket and task.
2. The gain of a bucket is the log ratio of its smoothed shares. The gains are one array, and a
   document's weight is the mean of the entries its words point at. Noise of the Gumbel
   distribution, fixed by the id, turns the highest scores into a sample without replacement.
3. The score where the sample ends is bracketed by a quantile sketch. How many rows lie
   above the bracket and in it is counted exactly; a bracket that misses is widened. Only
   the rows in it are sorted, to find the one that the sample ends with.
4. The drawn rows, and no others, are sorted for their ranks.

Gains are as many as there are buckets, so they may go to all tasks; nothing else leaves them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, whole_text
from tilewright.operators.ordered import with_rank
from tilewright.session import write_table


@dataclass(frozen=True)
class Settings:
    words: int = 1  # features are runs of 1 to so many words
    buckets: int = 10_000
    least_words: int = 20  # shorter documents are not drawn
    percent: int = 10
    seed: int = 2024
    accuracy: int = 10_000  # of the quantile sketch


#: What each byte of a text becomes: A-Z in lower case, other ASCII but digits and letters a blank.
LETTERS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def features(text: bytes, s: Settings) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    words = text.translate(LETTERS).split()
    runs = words
    if s.words > 1:
        runs = [b" ".join(words[i : i + n]) for n in range(1, s.words + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(s.buckets)


def bucket_counts(texts: DataFrame, s: Settings, text_col: str = "text") -> np.ndarray:
    """Features of all texts per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(features(value.as_buffer().to_pybytes(), s)[1], minlength=s.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select(whole_text(text_col).cast("binary")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(s.buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share of the target / share of the source)), both with one added to each bucket."""
    size = len(source)
    of_source, of_target = float(source.sum()) + size, float(target.sum()) + size
    ratios = [(t + 1.0) * of_source / ((s + 1.0) * of_target) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gains: np.ndarray, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for value in batch.column(2):
                n, at = features(value.as_buffer().to_pybytes(), s)
                n_words.append(n)
                n_features.append(len(at))
                weight.append(int(gains[at].sum()) // len(at) if len(at) else 0)
            score = np.array(weight, np.int64) + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), noise(id_col, s.seed).alias("noise"), whole_text(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def bracket(able: DataFrame, k: int, n: int, accuracy: int) -> tuple[int, int, int]:
    """Scores between which the k-th highest of ``n`` lies, and how many are above them."""
    reach = 5.0 / accuracy
    while True:
        low, high = max(0.0, 1 - k / n - reach), min(1.0, 1 - k / n + reach)
        at = able.agg(F.percentile_approx("score", [low, high], accuracy).alias("at")).first().at
        inside = F.col("score").between(*at)
        over, within = able.agg(F.count_if(F.col("score") > at[1]), F.count_if(inside)).first()
        if over < k <= over + within:
            return at[0], at[1], over
        reach *= 4


def drawn_order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]


def last_drawn(able: DataFrame, k: int, n: int, accuracy: int) -> tuple:
    """Score and id of the k-th row in the order of drawing."""
    low, high, over = bracket(able, k, n, accuracy)
    near = with_rank(able.where(F.col("score").between(low, high)), drawn_order(), "place")
    row = near.where(F.col("place") == k - over - 1).first()
    return row.score, row.doc_id


def resampled(
    docs: DataFrame, target: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    ``rank`` counts the drawn documents from 1, in the order of falling scores; of equal scores
    the smaller id comes first, a null id last, and rows repeated under one id rank side by side.
    Documents that are not drawn have a null rank. Null texts count as empty: no features, weight 0.
    A null id has the noise of an empty one. Without rows, or without a document long
    enough, nothing is drawn; without target texts all target counts are zero. Other
    columns are ignored.
    """
    s = settings or Settings()
    columns_of(docs, id_col, text_col)
    columns_of(target, target_col)
    gains = bucket_gains(bucket_counts(docs, s, text_col), bucket_counts(target, s, target_col))
    rows = write_table(scored(docs, gains, s, id_col, text_col), "scores")
    able = rows.where(F.col("n_words") >= s.least_words)
    n = able.count()
    k = s.percent * n // 100
    rank = F.lit(None).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, rank)
    score, last = last_drawn(able, k, n, s.accuracy)
    ties = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= F.lit(last), F.lit(False))
    taken = (F.col("n_words") >= s.least_words) & ((F.col("score") > score) | ((F.col("score") == score) & ties))
    drawn = with_rank(rows.where(taken).select(*out), drawn_order())
    place = F.when(F.col("rank") < k, F.col("rank") + 1)  # more than k only if the last row is repeated
    return drawn.withColumn("rank", place).unionByName(rows.where(~taken).select(*out, rank))
