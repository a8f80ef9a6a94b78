"""Numbering and lookups that hold when one bundle has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.session import durable

HOT_KEYS = 256
SALTS = 4096


def number_rows(
    keys: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Sequence[str] = (),
) -> DataFrame:
    """Add ``row_no`` and ``group_rows`` (1-based, per group, in order).

    For each name in ``totals`` also ``<name>_before``, the sum over the
    earlier rows of the group, and ``<name>_total``.

    A window over the whole group would put a huge bundle in one task. The rows
    are range-partitioned on (group, order) instead, numbered within their
    slice, and shifted by what the earlier slices of the group hold. Only one
    row per (slice, group) takes part in the second step. The slices are
    checkpointed first: both steps must see the same split. Pass narrow rows;
    wide columns are joined back by the caller on a unique key.
    """
    group, order, totals = list(group), list(order), list(totals)
    sliced = durable(
        keys.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", 33))
    )
    per_slice = sliced.groupBy("_slice", *group).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_at").alias("_first"),
        *[F.sum(t).alias(f"_sum_{t}") for t in totals],
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    shifts = per_slice.select(
        F.col("_slice").alias("_slice_of"),
        *[F.col(g).alias(f"_group_{i}") for i, g in enumerate(group)],
        (before("_rows") - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(whole).alias("group_rows"),
        *[before(f"_sum_{t}").alias(f"_before_{t}") for t in totals],
        *[F.sum(f"_sum_{t}").over(whole).alias(f"{t}_total") for t in totals],
    )
    if totals:
        inside = (
            Window.partitionBy("_slice", *group)
            .orderBy("_at")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        sliced = sliced.select(
            "*",
            *[
                F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_inside_{t}")
                for t in totals
            ],
        )
    same = F.col("_slice") == F.col("_slice_of")
    for i, g in enumerate(group):  # a null group is a group
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{i}"))
    return sliced.join(shifts, same).select(
        *keys.columns,
        (F.col("_at") + F.col("_shift")).alias("row_no"),
        "group_rows",
        *[
            (F.col(f"_before_{t}") + F.col(f"_inside_{t}")).alias(f"{t}_before")
            for t in totals
        ],
        *[F.col(f"{t}_total") for t in totals],
    )


def skew_safe_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    values: Sequence[str],
    weight: str,
    spread_by: Sequence[str],
) -> DataFrame:
    """Left join ``rows`` to a table keyed by ``on`` when few keys own most rows.

    ``weight`` is the number of rows a key of ``table`` is looked up by. The
    ``HOT_KEYS`` heaviest keys are answered by a join of their own, which Spark's size
    check broadcasts; their rows then take a salted key so the shuffle join for
    all other keys stays even.
    """
    on, values = list(on), list(values)
    heavy = (
        table.orderBy(F.desc(weight))
        .limit(HOT_KEYS)
        .select(*on, F.struct(*values).alias("_hot"))
    )
    # Taken from a column: a literal would be folded out of the join key.
    unsalted = F.when(F.col(weight) > 0, 0)
    rest = table.select(*on, unsalted.alias("_salt"), F.struct(*values).alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        F.pmod(F.hash(*spread_by), F.lit(SALTS)) + 1
    )
    joined = (
        rows.join(heavy, on, "left")
        .withColumn("_salt", salt)
        .join(rest, [*on, "_salt"], "left")
    )
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])
