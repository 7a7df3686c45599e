"""The operators bound to the driver's tables: one query each, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontam, html, importance, jaccard, licenses, oracles, packing, pivots, quality, sharding, substrings, suffixes, warc, whitening
from loomline.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(read(spark, sf_dir, "documents"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.word_repeats(read(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "spans")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.byte_repeats(read(spark, sf_dir, "documents"), keep_first=False)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(read(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_kd_sharding": op2_kd_sharding,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_warc_bundles": op8_warc_bundles,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_license_scan": op10_license_scan,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_pivot_top_k": op13_pivot_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
