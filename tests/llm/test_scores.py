"""Classifiers: held-out accuracy, folds, and texts at the edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tilewright.llm.quality import Features, Machine, Settings, fit_machine, fit_quality, quality_scores
from tilewright.llm.queries import op2_quality_machine, op6_toxicity
from tilewright.llm.toxicity import fit_ftrl, labelled_sample
from tilewright.llm.toxicity import Settings as ToxicSettings
from tilewright.llm.toxicity import fit_toxicity, toxicity_scores

DIR = "/root/testdata/sf0.01"


def held_out(spark, query, label, divisor, rest):
    got = query(spark, DIR).cache()
    assert got.count() == 1000 and got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    for r in got.select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == rest)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    return got.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, op2_quality_machine, "quality", 3, 1)
    assert len(rows) > 100 and (rows.predicted == rows.y).mean() >= 0.97


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, op6_toxicity, "toxic", 5, 0)
    clean, toxic = rows[rows.y == 0], rows[rows.y == 1]
    assert (clean.predicted == 0).mean() >= 0.97  # some 40 toxic texts to learn from
    assert toxic.score.mean() > clean.score.mean() + 0.3


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = Machine(0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    x = rng.normal(size=(5, 7))
    slow = [m.bias + r @ m.linear + sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i in range(7) for j in range(i)) for r in x]
    assert np.allclose(m.raw(x), slow)


def test_machine_learns_a_pure_interaction():
    s = Settings(buckets=4, epochs=200)
    x = np.zeros((400, s.width), np.float32)
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (400, 2))
    for k, (a, b) in enumerate(bits):
        x[k, [a, 2 + b]] = 1
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    assert ((fit_machine(x, y, s).scores(x) >= 0.5) == y).mean() == 1


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "x" * 200_000), (5, "ok " * 60_000), (None, "no id"), (6, "é\u0000 "), (6, "twice"), (6, "twice")]


def test_edges_and_no_labels(table, spark):
    docs = table(EDGES, "doc_id", "text", extra=("node", "label", "place"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (
        quality_scores(docs, fit_quality(docs, none, F.lit(True))),
        toxicity_scores(docs, fit_toxicity(docs, none, F.lit(True))),
    ):
        rows = scored.collect()
        assert len(rows) == len(EDGES) and set(scored.columns) == {*docs.columns, "score", "predicted"}
        assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity_scores(table([], "doc_id", "text"), (np.zeros(0, np.uint32), np.zeros(0), 0.0)).collect() == []


def test_null_and_repeated_labels(table, spark):
    rows = [(k, "you idiot go away" if k % 2 else "what a fine day it is") for k in range(60)]
    labels = [(k, k % 2) for k in range(60)] * 2 + [(None, 1), (3, None)]
    docs, labels = table(rows, "doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int")
    s = ToxicSettings(l1=0.5)
    got = toxicity_scores(docs, fit_toxicity(docs, labels, F.lit(True), s), s).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_scores_do_not_depend_on_partitions(table, spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    one, many = (fit_toxicity(d, labels, F.lit(True)) for d in (docs.coalesce(1), docs.repartition(7)))
    assert np.array_equal(one[0], many[0]) and np.array_equal(one[1], many[1]) and one[2] == many[2]
    assert len(Features(Settings()).of(b"")) == Settings().width


def test_one_id_on_many_rows_is_one_sampled_row(table, spark):
    docs = table([(1, f"text {k}") for k in range(500)] + [(2, "other")], "doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 100, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.label) for r in sample) == [(1, 1), (2, 0)]


def test_ftrl_follows_plain_loops():
    rng = np.random.default_rng(3)
    s = ToxicSettings(bits=5, l1=0.3, epochs=3)
    rows = [np.unique(rng.integers(0, 32, 6)).astype(np.uint32) for _ in range(40)]
    labels = [int(5 in r) for r in rows]
    at, weights, bias = fit_ftrl(rows, labels, s)
    z, n, z0, n0 = [0.0] * 32, [0.0] * 32, 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= s.l1:
            return 0.0
        return -(z[k] - (s.l1 if z[k] > 0 else -s.l1)) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for r, y in zip(rows, labels):
            b = -z0 / ((s.beta + n0**0.5) / s.alpha)
            p = 1 / (1 + np.exp(-(b + sum(weight(k) for k in r))))
            g = (p - y) * (s.positive_weight if y else 1.0)
            for k in r.tolist():
                w = weight(k)
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / s.alpha * w
                n[k] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / s.alpha * b
            n0 += g * g
    want = {k: weight(k) for k in range(32) if weight(k)}
    assert at.tolist() == list(want) and np.allclose(weights, list(want.values()))
    assert np.isclose(bias, -z0 / ((s.beta + n0**0.5) / s.alpha))
