"""Quality scores: a factorisation machine over hashed words, structure and metadata.

y(x) = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. With the sum-of-squares identity the
pairs cost as much as one more linear term: half of sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2).

The words of a text fall into ``buckets`` by hash and weigh log(1 + count) over the length of
that vector; next to them stand statistics of its structure (letter classes, repetition, marks)
and its length as metadata, each as a smooth one-hot over ``levels`` steps. The model is
fitted on a bounded sample in one task; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.llm.common import Cache, held, word_hashes
from tilewright.llm.toxicity import labelled_sample

#: Statistics of a text, each scaled to 0..1.
STATISTICS = (
    "upper", "lower", "digit", "mark", "space", "high", "line_ends", "marked_words", "upper_words", "lone_marks",
    "distinct_words", "top_word", "repeated_neighbours", "repeated_pairs", "distinct_lines", "word_length",
    "line_length", "ended_lines", "odd_marks", "bytes", "words", "lines",
)

MARKS = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])
ODD = np.array([chr(b) in "#$%&*@^_|~<>{}[]\\+=" for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """Training parameters; ``sample_rows`` bounds what one task holds while it fits."""

    buckets: int = 512
    levels: int = 8
    factors: int = 8
    sample_rows: int = 8_000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4

    @property
    def width(self) -> int:
        return self.buckets + len(STATISTICS) * self.levels


def statistics(data: bytes, words: list[bytes]) -> list[float]:
    """The values named in STATISTICS."""
    if not words:
        return [0.0] * len(STATISTICS)
    n, m = len(data), len(words)
    chars = np.frombuffer(data, np.uint8)
    by = np.bincount(chars, minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    last = [w[-1] for w in words]
    return [
        by[65:91].sum() / n,
        by[97:123].sum() / n,
        by[48:58].sum() / n,
        by[MARKS].sum() / n * 2,
        by[[32, 9, 10, 13]].sum() / n,
        by[128:].sum() / n,
        by[10] / n * 20,
        sum(ODD[c] or c == 33 for c in last) / m,
        sum(w.isupper() for w in words) / m,
        sum(len(w) == 1 and bool(MARKS[w[0]]) for w in words) / m,
        len(counts) / m,
        max(counts.values()) / m,
        neighbours / m,
        1 - pairs / max(1, m - 1),
        len(set(lines)) / len(lines),
        n / m / 20,
        n / len(lines) / 1000,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        by[ODD].sum() / n * 10,
        np.log1p(n) / 16,
        np.log1p(m) / 14,
        np.log1p(len(lines)) / 10,
    ]


class Features:
    """Dense feature vector of a text."""

    def __init__(self, s: Settings):
        self.s = s
        self.words = Cache(lambda w: xxhash.xxh3_64_intdigest(w) % s.buckets)

    def of(self, data: bytes) -> np.ndarray:
        s, words = self.s, data.split()
        x = np.zeros(s.width, np.float32)
        if words:
            bags = np.log1p(np.bincount(word_hashes(words, self.words).astype(np.int64), minlength=s.buckets))
            x[: s.buckets] = bags / np.linalg.norm(bags)
        at = np.clip(np.array(statistics(data, words)), 0, 1) * (s.levels - 1)
        low = np.minimum(at.astype(np.int64), s.levels - 2)
        places = s.buckets + np.arange(len(at)) * s.levels + low
        x[places], x[places + 1] = 1 - (at - low), at - low
        return x


def features(s: Settings) -> Features:
    return held(("quality", s), lambda: Features(s))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(axis=1) / 2
        return self.bias + x @ self.linear + pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit_machine(x: np.ndarray, labels: np.ndarray, s: Settings) -> Machine:
    """Adagrad over small batches in a fixed order; both classes weigh the same in sum."""
    rng = np.random.default_rng(0)
    m = Machine(0.0, np.zeros(s.width, np.float32), rng.normal(0, 0.01, (s.width, s.factors)).astype(np.float32))
    if not len(labels):
        return m
    ones = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9))
    sums = [1e-6, np.full(s.width, 1e-6, np.float32), np.full(m.factors.shape, 1e-6, np.float32)]
    for _ in range(s.epochs):
        order = rng.permutation(len(labels))
        for at in np.array_split(order, max(1, len(order) // s.batch)):
            b = x[at]
            g = ((m.scores(b) - labels[at]) * weight[at] / len(at)).astype(np.float32)
            inner = b @ m.factors
            steps = (
                float(g.sum()),
                b.T @ g + s.decay * m.linear,
                b.T @ (g[:, None] * inner) - m.factors * ((b * b).T @ g)[:, None] + s.decay * m.factors,
            )
            for k, step in enumerate(steps):
                sums[k] = sums[k] + step * step
            m.bias -= s.rate * steps[0] / sums[0] ** 0.5
            m.linear -= s.rate * steps[1] / np.sqrt(sums[1])
            m.factors -= s.rate * steps[2] / np.sqrt(sums[2])
    return m


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings | None = None, label: str = "quality",
    id_col: str = "doc_id", text_col: str = "text",
) -> Machine:
    """Fit on at most ``sample_rows`` labelled texts for which ``learn`` holds.

    Without labels the linear weights stay zero and all scores are near 0.5.
    """
    s = settings or Settings()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features(s)
        for batch in batches:
            rows = [make.of(v.as_buffer().to_pybytes()).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.binary())], names=["place", "label", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, s.width)
        m = fit_machine(x, np.array([r[1] for r in rows], np.float64), s)
        parts = [pa.array([v.tobytes()], pa.binary()) for v in (m.linear, m.factors)]
        yield pa.RecordBatch.from_arrays([pa.array([float(m.bias)], pa.float64()), *parts], names=["bias", "linear", "factors"])

    sample = labelled_sample(docs, labels, label, learn, s.sample_rows, id_col, text_col)
    made = sample.select("text", "place", "label").mapInArrow(extract, "place long, label int, x binary")
    row = made.repartition(1).mapInArrow(fit, "bias double, linear binary, factors binary").collect()[0]
    linear, factors = (np.frombuffer(v, np.float32) for v in (row.linear, row.factors))
    return Machine(row.bias, linear, factors.reshape(s.width, s.factors))


def quality_scores(docs: DataFrame, machine: Machine, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null text counts as empty, and an empty text has a score like any other. Columns of
    ``docs`` named score or predicted are replaced.
    """
    s = settings or Settings()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features(s)
        for batch in batches:
            texts = batch.column(place)
            scores = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 256):
                part = [make.of(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in texts[at : at + 256]]
                scores[at : at + 256] = machine.scores(np.array(part, np.float32).reshape(-1, s.width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    kept = docs.drop("score", "predicted")
    place = kept.columns.index(text_col)
    return kept.mapInArrow(score, StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer"))
