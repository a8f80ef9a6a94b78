"""Writers for bundles, reports and the profile store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindery.operators.sections import in_order
from bindery.options import Options

FILE_CHARS = 1 << 27
STORE = (
    "profiles map<string, map<string, {value}>>, prompt_templates map<string, string>, "
    "exported_at string, version string"
)
STORE_VERSION = "1.0"


def file_stamp(as_of: str):
    return F.date_format(F.lit(as_of).cast("timestamp"), "yyyyMMdd_HHmmss")


def write_bundles(
    sections: DataFrame, path: str, options: Options, max_chars: int = FILE_CHARS
) -> None:
    """Write each bundle in order under ``bundle_file=<bundle>_<stamp>.txt``.

    The text of all bundles, one after the other, is cut where ``max_chars`` are
    passed, and each task writes one such slot: the names of a bundle's part files
    follow its text. One shuffle deals the sections to the tasks. Every section ends
    with the newline the writer puts after each row.
    """
    name = F.concat("bundle", F.lit("_"), file_stamp(options.as_of), F.lit(".txt"))
    by_name = sections.select("bundle").distinct().withColumn("source_ord", F.lit(0))
    (
        in_order(sections, options.output_format, max_chars, by_name, task_per_slot=True)
        .select(name.alias("bundle_file"), "position", "section")
        .sortWithinPartitions("bundle_file", "position")
        .select("bundle_file", "section")
        .write.partitionBy("bundle_file")
        .text(path)
    )


def write_report(manifest: DataFrame, path: str) -> None:
    manifest.write.parquet(path)


def _settings() -> Column:
    """A profile's settings as a map in the order of their keys; values may be of a type without order."""
    by_key = F.array_sort(
        F.collect_list(F.struct("key", "value")),
        lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    return F.map_from_entries(by_key)


def export_store(
    profiles: DataFrame, templates: DataFrame, path: str, exported_at: str
) -> None:
    """Profiles ``(name, key, value)`` and templates ``(name, body)`` as JSON lines.

    Each line holds one profile or template in the shape ``import_store`` reads. A
    value may be text or a VARIANT: numbers, booleans, lists, objects and null then
    are written as such.
    """
    stamp = [F.lit(exported_at).alias("exported_at"), F.lit(STORE_VERSION).alias("version")]
    saved = profiles.groupBy("name").agg(_settings().alias("settings")).select(
        F.create_map("name", "settings").alias("profiles"), *stamp
    )
    bodies = templates.select(F.create_map("name", "body").alias("prompt_templates"), *stamp)
    # Nulls are values here: a setting may be null.
    lines = saved.unionByName(bodies, allowMissingColumns=True)
    lines.write.option("ignoreNullFields", False).json(path)


def import_store(
    spark: SparkSession, path: str, multi_line: bool = False, typed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Read an export back; ``multi_line`` for one JSON document per file.

    Values come back as text, or with ``typed`` as VARIANT.
    """
    schema = STORE.format(value="variant" if typed else "string")
    store = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    profiles = store.select(F.explode("profiles").alias("name", "settings")).select(
        "name", F.explode("settings").alias("key", "value")
    )
    templates = store.select(F.explode("prompt_templates").alias("name", "body"))
    return profiles, templates
