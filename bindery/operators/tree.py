"""Directory tree lines, one row per folder or file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions.paths import components
from bindery.operators.ordering import skew_safe_lookup
from bindery.session import durable

# A key element is "0" + folder name or "1" + file name: arrays of them sort
# in pre-order with folders before files at each level.
_FOLDER, _FILE = "0", "1"


def _nodes(files: DataFrame) -> DataFrame:
    """Files and distinct folders ``(bundle, key, is_folder, weight)``.

    The weight of a folder is its files plus the filled folders below it: how
    often its children and descendants will look it up.
    """
    named = files.select("bundle", components(F.col("rel_path")).alias("parts")).select(
        "bundle",
        F.transform(
            F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.concat(F.lit(_FOLDER), p)
        ).alias("folder"),
        F.concat(F.lit(_FILE), F.element_at("parts", -1)).alias("leaf"),
    )
    folders = (
        named.filter(F.size("folder") > 0)
        .groupBy("bundle", "folder")
        .agg(F.count(F.lit(1)).alias("files"))
        .select("bundle", "folder", "files", F.explode(_levels("folder")).alias("level"))
        .groupBy("bundle", F.slice("folder", F.lit(1), F.col("level")).alias("key"))
        .agg(
            F.sum(F.when(F.col("level") == F.size("folder"), F.col("files") + 1).otherwise(1)).alias(
                "weight"
            )
        )
    )
    leaves = named.select("bundle", F.concat("folder", F.array("leaf")).alias("key"))
    return folders.withColumn("is_folder", F.lit(True)).unionByName(
        leaves.withColumn("is_folder", F.lit(False)).withColumn("weight", F.lit(0).cast("bigint"))
    )


def _levels(key: str) -> Column:
    return F.sequence(F.lit(1), F.size(key))


def _parent(key: str) -> Column:
    return F.slice(key, F.lit(1), F.size(key) - 1)


def tree_lines(files: DataFrame) -> DataFrame:
    """``(bundle, key, line)``; ordering by key gives the printed tree.

    The first line is the folder's own name, ``top``, where files have it.

    A node is last when it is the greatest of its folder, which a partial
    aggregate finds before the shuffle. The indent of a folder is made from
    the last flags of its own ancestors, and looked up by its children. Nodes
    and indents are read by several steps, so both are kept; they hold paths only.
    """
    nodes = _nodes(files)
    last = (
        nodes.groupBy("bundle", _parent("key").alias("parent"))
        .agg(F.max(F.element_at("key", -1)).alias("name"))
        .select("bundle", F.concat("parent", F.array("name")).alias("key"), F.lit(True).alias("last"))
    )
    # The join key is unique on both sides.
    flagged = durable(
        nodes.join(last, ["bundle", "key"], "left").fillna(False, ["last"])
    )
    folders = flagged.filter("is_folder")

    steps = folders.select(
        "bundle", F.col("key").alias("folder"), "weight", F.explode(_levels("key")).alias("level")
    ).withColumn("key", F.slice("folder", F.lit(1), F.col("level")))
    looked_up = skew_safe_lookup(
        steps, folders, ["bundle", "key"], ["last"], "weight", ["folder", "level"]
    )
    bars = F.transform(
        F.sort_array(F.collect_list(F.struct("level", "last"))),
        lambda s: F.when(s["last"], "    ").otherwise("│   "),
    )
    indents = durable(
        looked_up.groupBy("bundle", F.col("folder").alias("parent")).agg(
            F.array_join(bars, "").alias("indent"), F.max("weight").alias("weight")
        )
    )
    named = skew_safe_lookup(
        flagged.drop("weight").withColumn("parent", _parent("key")),
        indents,
        ["bundle", "parent"],
        ["indent"],
        "weight",
        ["key"],
    )
    line = F.concat(
        F.coalesce("indent", F.lit("")),
        F.when(F.col("last"), "└── ").otherwise("├── "),
        F.substring(F.element_at("key", -1), 2, 1 << 30),
        F.when(F.col("is_folder"), "/").otherwise(""),
    )
    top = F.col("top") if "top" in files.columns else F.col("bundle")
    roots = files.select("bundle", top.alias("top")).distinct()
    return roots.select(
        "bundle",
        F.array().cast("array<string>").alias("key"),
        F.concat("top", F.lit("/")).alias("line"),
    ).unionByName(named.select("bundle", "key", line.alias("line")))


def tree_sizes(files: DataFrame) -> DataFrame:
    """``(bundle, chars, lines)`` of the tree's lines with their newlines, summed up; nothing is drawn.

    A line is as long as four characters per level, its name and a folder's slash.
    """
    top = F.col("top") if "top" in files.columns else F.col("bundle")
    roots = files.select("bundle", top.alias("top")).distinct().select("bundle", (F.length("top") + 2).alias("chars"))
    own = F.length(F.element_at("key", -1)) + F.col("is_folder").cast("int")  # its mark stands in for the newline
    lines = _nodes(files).select("bundle", (4 * F.size("key") + own).alias("chars"))
    return roots.unionByName(lines).groupBy("bundle").agg(
        F.sum(F.col("chars").cast("bigint")).alias("chars"), F.count(F.lit(1)).alias("lines")
    )
