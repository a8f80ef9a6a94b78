"""Where each section stands in its bundle's text; the text itself moves once.

Numbers come from narrow rows: (bundle, part, key, chars) are numbered and summed
up, and where a bundle passes ``max_chars`` a new slot starts. A slot is a chunk of
text or a file. Its first key is all a section needs to find it: the starts of a
bundle's slots are one sorted array, searched by halving. So the text is dealt by
(bundle, slot) in one shuffle and numbered inside its slot, or where a task holds one slot, by their order in the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.operators.ordering import number_rows
from bindery.session import durable

SLOT_CHARS = 1 << 26
#: Up to so many slot starts are broadcast (some 100 bytes each); beyond, sections are joined to their numbers.
BROADCAST_STARTS = 500_000


def index_digits(n: Column) -> Column:
    """How many digits the numbers 1 to n have together."""
    n = n.cast("bigint")
    digits = F.length(n.cast("string")).cast("bigint")
    return digits * (n + 1) - ((F.pow(F.lit(10), digits) - 1) / 9).cast("bigint")


def _numbered(sections: DataFrame, numbered_chars: bool, max_chars: int, sources: DataFrame | None) -> DataFrame:
    """(bundle, part, key, row_no, slot) of every section, on narrow rows."""
    keys = sections.select("bundle", "part", "key", "chars")
    group, order = ["bundle"], ["part", "key"]
    if sources is not None:
        listed = sources.select(F.col("bundle").alias("_listed"), "source_ord")
        keys = keys.join(listed, F.col("bundle").eqNullSafe(F.col("_listed"))).drop("_listed")
        group, order = [], ["source_ord", "bundle", "part", "key"]
    numbered = number_rows(keys, group, order, ["chars"])
    before = F.col("chars_before")
    if numbered_chars and sources is None:  # the head is row 1, so a body's number is its row less 1
        before = before + index_digits(F.greatest(F.col("row_no") - 2, F.lit(0)))
    return numbered.select("bundle", "part", "key", "row_no", F.floor(before / F.lit(max_chars)).cast("bigint").alias("slot"))


def placed(
    sections: DataFrame,
    max_chars: int = SLOT_CHARS,
    sources: DataFrame | None = None,
    numbered_chars: bool = False,
    task_per_slot: bool = False,
) -> DataFrame:
    """Add ``slot``, ``position`` and ``index`` to sections (bundle, part, key, chars, ...).

    Positions count from 1 in each bundle, or with ``sources`` (bundle, source_ord)
    over all bundles in that order; ``index`` from 0 in each bundle. ``max_chars``
    bounds a slot by what comes before its last section. ``numbered_chars`` is for
    texts that print each body's index, which ``chars`` leaves out. Up to
    ``BROADCAST_STARTS`` slots, the rows of one are together in one task. With
    ``task_per_slot`` and ``sources`` task i holds slot i, whatever its bundles.
    """
    numbered = _numbered(sections, numbered_chars, max_chars, sources)
    first = F.min(F.struct("part", "key")).alias("first")
    starts = durable(numbered.groupBy("bundle", "slot").agg(first, F.min("row_no").alias("row_no")))
    if task_per_slot:  # counted from the first row of the whole slot, not of a bundle in it
        starts = starts.withColumn("counted_from", F.min("row_no").over(Window.partitionBy("slot")))
    else:
        starts = starts.withColumn("counted_from", F.col("row_no"))
    found = starts.count()
    opened = starts.groupBy(F.col("bundle").alias("_bundle")).agg(
        F.min("row_no").alias("_opens"), F.sort_array(F.collect_list(F.struct("first", "slot", "counted_from"))).alias("_starts")
    )
    slots = (starts.agg(F.max("slot")).first()[0] or 0) + 1
    if found <= BROADCAST_STARTS:
        own = F.struct("part", "key")
        steps = F.array(*[F.lit(1 << k) for k in range(found.bit_length(), -1, -1)])
        passed = F.aggregate(
            steps, F.lit(0), lambda at, step: F.when(F.get("_starts", at + step - 1)["first"] <= own, at + step).otherwise(at)
        )
        routed = (
            sections.join(F.broadcast(opened), F.col("bundle").eqNullSafe(F.col("_bundle")))
            .withColumn("_start", F.get("_starts", passed - 1))
            .select(*sections.columns, "_opens", F.col("_start.slot").alias("slot"), F.col("_start.counted_from").alias("_row_no"))
        )
        if task_per_slot:
            in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            dealt = routed.repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("_opens", "part", "key")
            out = dealt.withColumn("position", F.col("_row_no") + in_task).drop("_row_no")
        else:
            inside = Window.partitionBy("bundle", "slot").orderBy("part", "key")
            out = routed.withColumn("position", F.col("_row_no") + F.row_number().over(inside) - 1).drop("_row_no")
    else:
        keys = numbered.select(*[F.col(c).alias(f"_{c}") for c in ("bundle", "part", "key")], "slot", F.col("row_no").alias("position"))
        same = F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("part") == F.col("_part")) & (F.col("key") == F.col("_key"))
        joined = sections.join(keys, same).drop("_bundle", "_part", "_key")
        opens = opened.select(F.col("_bundle"), "_opens")
        out = joined.join(opens, F.col("bundle").eqNullSafe(F.col("_bundle"))).drop("_bundle")
        if task_per_slot:
            out = out.repartitionById(slots, F.col("slot").cast("int"))
    return out.withColumn("index", F.col("position") - F.col("_opens")).drop("_opens")
