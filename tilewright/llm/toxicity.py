"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are the words it holds, their stems (the first letters), pairs of
neighbours and pairs with one word between, each hashed to ``bits`` bits and counted once.
Every coordinate has a learning rate of its own and an L1 penalty, so nearly all weights
are exactly zero; what remains is a short list of indices and weights that goes to every task.

The model is fitted on a bounded sample: the ``sample_rows`` labelled texts with the lowest
hash of their id. Scoring covers all rows, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.llm.common import Cache, chained, held, mixed, released, whole_text
from tilewright.session import write_table

WORD = re.compile(rb"[a-z\x80-\xff]+")
STEMS = (4, 5)  # letters of the stem features


@dataclass(frozen=True)
class Settings:
    """Training parameters; ``sample_rows`` bounds what one task holds while it fits."""

    bits: int = 20
    sample_rows: int = 12_000
    seen: int = 5  # a feature enters the model when so many sampled texts hold it
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.5
    positive_weight: float = 3.0


class Features:
    """Indices of the features of a text."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.words = Cache(self._word, limit=64 << 20, entry=320)

    def _word(self, word: bytes) -> tuple[int, ...]:
        """Hashes of the word and of its stems."""
        text = word.decode("utf-8", "ignore")
        stems = [xxhash.xxh3_64_intdigest(text[:n].encode(), seed=n) if len(text) >= n else 0 for n in STEMS]
        return xxhash.xxh3_64_intdigest(word), *stems

    def of(self, text: bytes) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint32)
        hashes = np.array([self.words[w] for w in words], dtype=np.uint64)
        stems = hashes[:, 1:].ravel()
        parts = [mixed(hashes[:, 0]), stems[stems > 0], chained(hashes[:, 0], (1,)), chained(hashes[:, 0], (2,))]
        return np.unique((np.concatenate(parts) >> self.shift).astype(np.uint32))


def features(bits: int) -> Features:
    return held(("toxicity", bits), lambda: Features(bits))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit_ftrl(rows: list[np.ndarray], labels: list[int], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights that are not zero, and the bias, after ``epochs`` passes in the given order."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias_z = bias_n = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for at, label in zip(rows, labels):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            bias = -bias_z / ((s.beta + bias_n**0.5) / s.alpha)
            g = (sigmoid(float(w.sum()) + bias) - label) * (s.positive_weight if label else 1.0)
            root = np.sqrt(ni)
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
            n[at] = ni + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / s.alpha * bias
            bias_n += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.uint32), w[at], -bias_z / ((s.beta + bias_n**0.5) / s.alpha)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled ids for which ``learn`` holds, chosen by a hash of the id.

    One row per id: of several texts under an id the greatest stands for it.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(learn)
    chosen = chosen.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = chosen.orderBy(order, "doc_id").limit(rows).withColumn("place", order)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` narrow rows
    return found.groupBy("doc_id", "label", "place").agg(F.max("text").alias("text"))


def common_features(made: DataFrame, s: Settings) -> np.ndarray:
    """Bits of the features that at least ``seen`` rows hold. Tasks count before they send; 2 ** bits bounds the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = np.zeros(1 << s.bits, np.int32)
        for batch in batches:
            for value in batch.column(0):
                texts[np.frombuffer(value.as_buffer(), np.uint32)] += 1  # indices of one text are distinct
        held_ = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(held_, pa.int64()), pa.array(texts[held_], pa.int64())], names=["feature", "n"])

    counts = made.select("at").mapInArrow(released(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    keep = np.zeros(1 << s.bits, bool)
    keep[counts.where(F.col("n") >= s.seen).select("feature").toArrow().column(0).to_numpy()] = True
    return np.packbits(keep)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings | None = None, label: str = "toxic",
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded sample of the labels for which ``learn`` holds.

    Features are made by many tasks, and those in fewer than ``seen`` texts are left out there;
    one task gathers what is left of at most ``sample_rows`` rows, and fits. Without labels all weights are zero and scores are 0.5.
    """
    s = settings or Settings()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features(s.bits)
        for batch in batches:
            rows = [make.of(x.as_buffer().to_pybytes()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.binary())], names=["place", "label", "at"])

    sample = labelled_sample(docs, labels, label, learn, s.sample_rows, id_col, text_col)
    made = sample.select("text", "place", "label").mapInArrow(released(extract), "place long, label int, at binary")
    made = write_table(made, "features")
    bits = common_features(made, s)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(bits).astype(bool)
        for batch in batches:
            rows = (np.frombuffer(value.as_buffer(), np.uint32) for value in batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([at[keep[at]].tobytes() for at in rows], pa.binary())], names=["place", "label", "at"]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Views of what Arrow received: the sample is held once.
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
        rows.sort(key=lambda r: (r[0], r[1], r[2].as_buffer().to_pybytes()[:64]))
        at, w, bias = fit_ftrl([np.frombuffer(r[2].as_buffer(), np.uint32) for r in rows], [r[1] for r in rows], s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())],
            names=["at", "w", "bias"],
        )

    thinned = made.mapInArrow(released(thin), "place long, label int, at binary")
    model = thinned.repartition(1).mapInArrow(released(fit), "at binary, w binary, bias double").collect()[0]
    return np.frombuffer(model.at, np.uint32), np.frombuffer(model.w), model.bias


def toxicity_scores(
    docs: DataFrame, model: tuple, settings: Settings | None = None, text_col: str = "text",
    into: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null text counts as empty; a text without words gets the score of the bias alone.
    ``into`` names the two columns; columns of ``docs`` with these names are replaced.
    """
    bits = (settings or Settings()).bits
    at, w, bias = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, weights = features(bits), np.zeros(1 << bits)
        weights[at] = w
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(place))
            scores = [sigmoid(float(weights[make.of(x)].sum()) + bias) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())],
                names=[*batch.schema.names, *into],
            )

    kept = docs.drop(*into)
    place = kept.columns.index(text_col)
    return kept.mapInArrow(released(score), StructType(list(kept.schema.fields)).add(into[0], "double").add(into[1], "integer"))
