"""Registered queries of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, divergence, html_text, languages, line_runs, near_dup, packing, quality, sketches, substrings, suffix_buckets,
               toxicity, whitening)

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .select("doc_id", "held_out", "score", "predicted"))


def op6_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_doubling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("text")


def op10_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op11_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identified(table(spark, sf_dir, "documents"))


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Let Python workers that run beside this source tree import it; elsewhere the package is installed or sent along."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: with_package(f) for f in (
        op1_best_fit_packing, op2_subsequence_svm, op3_composite_density, op4_line_dedup, op5_quality_rules, op6_bucket_pointers,
        op7_hyperminhash, op8_simhash_windows, op9_doubling_windows, op10_paragraph_sketch, op11_ecoc_language,
        op12_feast_whitening, op13_count_bitmaps, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_runs.ORACLE, "op13_count_bitmaps": divergence.ORACLE}
