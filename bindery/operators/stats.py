"""Statistics of bundles and of the whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import paths, tokens
from bindery.operators.sections import text_chars


def _type(path: Column) -> Column:
    """Suffix, where none counts as ``.txt``."""
    ext = paths.suffix(path)
    return F.when(ext == "", ".txt").otherwise(ext)


def file_types(files: DataFrame) -> DataFrame:
    return files.groupBy("bundle", _type(F.col("rel_path")).alias("ext")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")
    )


def file_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and the suffix map; a run lists its suffixes, so maps are short."""
    entry = F.struct("ext", "n")
    return (
        file_types(files)
        .groupBy("bundle")
        .agg(
            F.sum("n").alias("total_files"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"),
            F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("file_types"),
        )
    )


def text_totals(sections: DataFrame, output_format: str = "standard") -> DataFrame:
    """Characters, lines and tokens of each bundle's text, headers included.

    Summed over sections: the text itself is never put together.
    """
    open_end = 1 if output_format == "xml" else 0
    return (
        sections.groupBy("bundle")
        .agg(
            text_chars(output_format).alias("character_count"),
            (F.sum("lines") + 1 - open_end).alias("line_count"),
        )
        .withColumn("token_count", tokens.estimate(F.col("character_count")))
    )


def bundle_stats(files: DataFrame, sections: DataFrame, output_format: str = "standard") -> DataFrame:
    chars, size = F.col("character_count"), F.col("total_size_bytes")
    return (
        file_totals(files)
        .join(text_totals(sections, output_format), "bundle")
        .select(
            "bundle",
            "total_files",
            "file_types",
            "total_size_bytes",
            F.round(size / 1024, 2).alias("total_size_kb"),
            "character_count",
            "line_count",
            "token_count",
            F.when(
                F.col("total_files") > 0,
                F.round(F.col("token_count") / F.col("total_files"), 2),
            )
            .otherwise(0.0)
            .alias("avg_tokens_per_file"),
            F.when(size > 0, F.round((1 - chars / size) * 100, 2))
            .otherwise(0.0)
            .alias("compression_ratio"),
        )
    )


def run_totals(stats: DataFrame, model: str = "gpt-4o") -> DataFrame:
    """Per bundle and, with a null bundle, for the run: bundles, files, tokens, cost."""
    return (
        stats.rollup("bundle")
        .agg(
            F.count(F.lit(1)).alias("bundles"),
            F.sum("total_files").alias("files"),
            F.sum("token_count").alias("tokens"),
        )
        .withColumn("cost_usd", F.round(tokens.cost(F.col("tokens"), F.lit(model)), 8))
    )
