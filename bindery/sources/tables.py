"""Tables that already hold text, seen as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import paths


def as_files(
    table: DataFrame, bundle: Column, rel_path: Column, text: Column, mtime: Column, root: str
) -> DataFrame:
    """Project a table with one text per row to the files schema.

    ``rel_path`` must be unique within its bundle, as paths of files are. Rows
    without a bundle go to the bundle ``none``.
    """
    bundle = F.coalesce(bundle, F.lit("none"))
    base = F.concat(F.lit(root + "/"), bundle)
    return table.select(
        bundle.alias("bundle"),
        base.alias("root"),
        F.concat(base, F.lit("/"), rel_path).alias("path"),
        rel_path.alias("rel_path"),
        paths.suffix(rel_path).alias("ext"),
        F.octet_length(text).cast("bigint").alias("length"),
        mtime.alias("modificationTime"),
        text.alias("text"),
        F.concat(bundle, F.lit("/"), rel_path).alias("display_path"),
        F.when(text.isNull(), "no text").alias("read_error"),
    )
