"""One query per text operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.alignment import aligned
from tilewright.llm.chat import rotate
from tilewright.llm.common import on_workers, remainder
from tilewright.llm.decontaminate import contamination
from tilewright.llm.exact_dedup import exact_groups
from tilewright.llm.html_extract import extract_main
from tilewright.llm.importance import resampled
from tilewright.llm.near_dedup import Settings as NearSettings
from tilewright.llm.near_dedup import near_duplicates
from tilewright.llm.packing import pack
from tilewright.llm.quality import fit_quality, quality_scores
from tilewright.llm.substring_dedup import long_repeats
from tilewright.llm.token_counts import token_counts
from tilewright.llm.toxicity import fit_toxicity, toxicity_scores
from tilewright.llm.warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("code")


def op2_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder(3)
    machine = fit_quality(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = quality_scores(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string")))
    return rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        "perspective",
        "part",
        "n_turns",
        F.length("text").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
        F.array_join(spans, ",").alias("mask"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder(5)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearSettings(words=2)).drop("code")


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_repeats(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_quality_machine,
        op3_best_fit_packing,
        op4_perspective_rotation,
        op5_token_counts,
        op6_toxicity,
        op7_minhash_near_dedup,
        op8_warc_normaliser,
        op9_site_style_tree,
        op10_prefix_decontamination,
        op11_recompression,
        op12_importance_resampling,
        op13_tokenizer_alignment,
    )
}
