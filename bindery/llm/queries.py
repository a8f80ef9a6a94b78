"""One registered query per operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindery.llm import (
    crf_language,
    equal_average,
    four_russians,
    fuzzy_lines,
    grouped_prefix,
    secrets,
    sentencepiece_fst,
    stable_projections,
    suffix_array_dedup,
    suffix_automata,
    token_files,
    url_filter,
    winnowing,
)
from bindery.llm.rows import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(table(spark, sf_dir, "pages"))


def op3_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.digest(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_projections.digest(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automata.digest(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.digest(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_prefix.digest(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_average.digest(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return four_russians.digest(table(spark, sf_dir, "embeddings"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filter": op2_url_filter,
    "op3_language_identification": op3_language_identification,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
