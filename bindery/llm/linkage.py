"""Connected components, and links found in buckets without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.rows import written

Verify = Callable[[DataFrame], DataFrame]
Within = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node reached.

    Alternates large-star and small-star steps (Kiveris and others, 2014): each
    points a node's neighbours to the least of them. A hub's edges are never
    gathered: its least neighbour comes from a partial aggregation and is joined
    back, a join that adaptive execution can split. Each round is a written
    table; the loop ends when all that is left are stars around their least node.
    """

    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        """``pairs`` (u, v) with each u's least neighbour or itself; then the kept pairs re-pointed."""
        least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = pairs.join(least, "u")
        if larger:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))

    def tidy(pairs: DataFrame) -> DataFrame:
        return written(pairs.filter("u <> v").distinct(), "components")

    def unfinished(pairs: DataFrame) -> bool:
        """Whether some node has two edges upwards, or is both above and below others."""
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                              F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        per_node = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return not per_node.filter("up > 1 or (up > 0 and down > 0)").isEmpty()

    now = tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while unfinished(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = tidy(stars(tidy(stars(both, larger=True)), larger=False))
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        roots.select("node", F.col("node").alias("label"))
    )


def linked(
    buckets: DataFrame,
    compatible: Callable[[Column, Column], Column],
    quick: Verify,
    full: Verify | None,
    rounds: int = 2,
    in_buckets: Within | None = None,
) -> DataFrame:
    """(node, label) of all nodes that have a link, where linked nodes share a bucket.

    ``buckets`` holds (bucket, node, rank, trait); the trait may be a struct. ``quick`` and
    ``full`` turn candidate pairs (a, b) into those that are links; ``quick`` may
    miss some. ``compatible`` is a cheap test on two traits; of every linked pair it
    must pass at least one bucket.

    A group of near copies would give a number of pairs that is the square of
    its size, though few links join it up. So each round first compares every
    node with one well-placed node (least ``rank``) of another component; that
    is linear. Pairs within one component need no test. What then remains,
    pairs of different components in one bucket, is compared in full, so no
    link between components is lost: nodes outside a bucket's largest component
    against all its nodes. ``in_buckets`` does that in place of ``full``, without a row for each pair: it turns
    (bucket, node, trait, label) of the buckets with several components into links (a, b)
    that join up all components with a link between them.
    """

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return buckets.withColumn("label", F.col("node"))
        return buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components after more links; earlier ones enter as (node, label) edges."""
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        return written(components(links), "labels")

    best = F.min(F.struct("rank", "node", "trait", "label"))
    labels = None
    for _ in range(rounds):
        rows = labelled(labels)
        first = rows.groupBy("bucket").agg(best.alias("first"))
        second = (
            rows.join(first, "bucket")
            .filter(F.col("label") != F.col("first")["label"])
            .groupBy("bucket")
            .agg(F.first("first").alias("first"), best.alias("second"))
        )
        to = F.when(F.col("label") != F.col("first")["label"], F.col("first")).otherwise(F.col("second"))
        pairs = (
            rows.join(second, "bucket")
            .withColumn("to", to)
            .filter(compatible(F.col("trait"), F.col("to")["trait"]))
            .groupBy("node")
            .agg(F.min("to")["node"].alias("to"))
            .select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))
            .distinct()
        )
        labels = relabelled(labels, written(quick(pairs), "links"))

    rows = labelled(labels)
    counted = rows.groupBy("bucket", "label").count()
    mixed = (
        counted.groupBy("bucket")
        .agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count(F.lit(1)).alias("labels"))
        .filter("labels > 1")
        .select("bucket", "major")
    )
    rest = rows.join(mixed, "bucket")
    if in_buckets is not None:
        return relabelled(labels, written(in_buckets(rest.select("bucket", "node", "trait", "label")), "links"))
    minor = rest.filter("label <> major").select(
        "bucket", F.col("node").alias("n1"), F.col("trait").alias("t1"), F.col("label").alias("l1")
    )
    pairs = (
        minor.join(rest, "bucket")
        .filter((F.col("l1") != F.col("label")) & compatible(F.col("t1"), F.col("trait")))
        .select(F.least("n1", "node").alias("a"), F.greatest("n1", "node").alias("b"))
        .distinct()
    )
    return relabelled(labels, written(full(pairs), "links"))
