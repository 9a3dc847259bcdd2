"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes what its predecessor kept. All but the last return the columns of
``documents``; rows with a null id cannot be named as copies, so both dedup stages let them pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import on_workers
from tilewright.llm.decontaminate import contamination
from tilewright.llm.exact_dedup import exact_groups, normalised
from tilewright.llm.near_dedup import Settings as NearSettings
from tilewright.llm.near_dedup import near_duplicates
from tilewright.llm.packing import pack
from tilewright.llm.toxicity import fit_toxicity, toxicity_scores
from tilewright.session import write_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a model of all toxicity labels does not call toxic. Null and empty texts are judged like any other."""
    labels = on_workers(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, F.lit(True))
    scored = toxicity_scores(docs, model, into=("_toxic_score", "_toxic"))
    return scored.where("_toxic = 0").select(docs.columns)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``dropped`` (doc_id, code), which is written, so that Spark
    knows its size. Other texts under the same id stay."""
    dropped = write_table(dropped.select("doc_id", F.col("code").alias("_code")).distinct(), "dropped")
    coded = docs.withColumn("_code", F.xxhash64(F.coalesce("text", F.lit(""))))
    return coded.join(dropped, ["doc_id", "_code"], "left_anti").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest of equal texts stays, then the one with the smallest id; rows repeated under an id are one.

    A null text counts as empty.
    """
    on_workers(spark)
    groups = write_table(exact_groups(docs), "exact")
    stays = without(docs, groups.where("not kept and doc_id is not null"))
    repeated = groups.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = write_table(repeated.where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return stays
    again = stays.join(repeated, "doc_id", "left_semi").withColumn("_plain", normalised(F.coalesce("text", F.lit(""))))
    again = again.dropDuplicates(["doc_id", "_plain"]).select(docs.columns)
    return stays.join(repeated, "doc_id", "left_anti").select(docs.columns).union(again)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more.

    Null and empty texts have no copies.
    """
    on_workers(spark)
    return without(docs, near_duplicates(docs, NearSettings(words=5)).where("not kept and doc_id is not null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark passages are less than a twentieth. Null and empty texts stay."""
    benchmark = on_workers(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark, row="row").where("not contaminated").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is one token, its end."""
    on_workers(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier decides in the first stage, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
